"""Chat formatting with tool calls, in DataFrame functions alone.

Calls and results are linked by a hash join on their identifier, calls are put in topological order of what they depend
on, their arguments are validated against the tools' schemas, and each call is serialised as canonical JSON (sorted
keys, no white space). A row of the result is one call: no conversation is ever collected into one value.

Of several results of one identifier the earliest counts. Null identifiers link with nothing and are in no order.
Repeated calls keep a row each and share level and results. Null, empty and very long arguments are judged and written
as they are (what isn't JSON is kept as text). Empty tables give no rows. Columns that clash with those of the result
belong to the caller: ``format_calls`` takes its inputs' columns by name, ``conversation_calls`` selects its own.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import forget, new_path, written

#: Types of arguments in schemas, and the pattern of what Spark calls them in parsed JSON.
TYPES = {"string": "STRING", "integer": "BIGINT", "number": r"BIGINT|DOUBLE|DECIMAL.*", "boolean": "BOOLEAN", "array": "ARRAY.*", "object": "OBJECT.*"}


def canonical(json: str) -> Column:
    """A column's JSON with sorted keys and no white space; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(json))


def link(calls: DataFrame, results: DataFrame) -> DataFrame:
    """``calls`` (call_id, ...) with ``n_results``, ``result_turn`` and ``result`` of ``results`` (call_id, turn, content)."""
    earliest = F.min(F.struct("turn", "content"))
    found = results.where("call_id is not null").groupBy("call_id").agg(F.count("*").alias("n_results"), earliest.alias("r"))
    found = found.select("call_id", "n_results", F.col("r.turn").alias("result_turn"), F.col("r.content").alias("result"))
    return calls.join(found, "call_id", "left").withColumn("n_results", F.coalesce("n_results", F.lit(0)))


def _chains(single: DataFrame) -> DataFrame:
    """``call_id, anchor, dist`` of calls (call_id, parent) with one parent: the nearest ancestor that isn't such a call.

    Pointers double with each pass, so a chain of n calls takes log2(n) passes. Calls on a cycle, or behind one, never
    reach an end and are left out: once a pass brings no further call to its end, only those remain.
    """
    known = single.select(F.col("call_id").alias("anchor"), F.lit(False).alias("ended"))
    state = single.select("call_id", F.col("parent").alias("anchor"), F.lit(1).alias("dist")).join(known, "anchor", "left")
    state = written(state.select("call_id", "anchor", "dist", F.coalesce("ended", F.lit(True)).alias("ended")), "chains")
    before, left = None, state.where("not ended").count()
    while left and left != before:
        step = state.select(F.col("call_id").alias("anchor"), F.col("anchor").alias("next"), F.col("dist").alias("more"), F.col("ended").alias("then"))
        moved = state.where("not ended").join(step, "anchor").select("call_id", F.col("next").alias("anchor"), (F.col("dist") + F.col("more")).alias("dist"), F.col("then").alias("ended"))
        after = written(state.where("ended").unionAll(moved), "chains")
        forget(state)
        state, before, left = after, left, after.where("not ended").count()
    return state.where("ended").select("call_id", "anchor", "dist")


def _junctions(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``call_id, level`` of calls with several parents; ``edges``: call_id, anchor (a root or such a call), weight.

    Each pass settles the calls whose anchors all have levels; an anchor that is null never gets one. What is settled
    goes to one folder, so the plan stays as small as that of the first pass.
    """
    spark = edges.sparkSession
    path, schema = new_path(spark, "settled"), "call_id string, level int"
    front, front_table = roots.select("call_id", F.lit(0).alias("level")), None
    waiting = written(edges.groupBy("call_id").agg(F.count("*").alias("open"), F.lit(0).alias("level")), "waiting")
    front.limit(0).write.parquet(path)
    while waiting.limit(1).count():
        met = edges.join(front.select(F.col("call_id").alias("anchor"), F.col("level").alias("from")), "anchor").groupBy("call_id").agg(F.count("*").alias("met"), F.max(F.col("from") + F.col("weight")).alias("high"))
        after = waiting.join(met, "call_id", "left").select("call_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open"), F.greatest("level", "high").alias("level"))
        after = written(after, "waiting")
        settled = written(after.where("open = 0").select("call_id", "level"), "front")
        settled.write.mode("append").parquet(path)
        rest = written(after.where("open > 0"), "waiting")
        forget(after, waiting, *([front_table] if front_table is not None else []))
        waiting, front, front_table = rest, settled, settled
        if not settled.limit(1).count():
            break
    return spark.read.schema(schema).parquet(path)


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, level``: 0 for calls that depend on no known call, else one more than the highest they depend on.

    ``calls`` has call_id and depends_on, an array of identifiers; unknown ones are left out. Calls on a cycle, and
    those behind one, have no row. Chains of calls with one parent shrink to a link to what stands before the chain, by
    pointer doubling; levels then pass along calls with several parents only, one pass for each on the longest way.
    """
    calls = calls.where("call_id is not null").select(F.col("call_id").cast("string").alias("call_id"), F.col("depends_on").cast("array<string>").alias("depends_on"))
    ids = written(calls.select("call_id").distinct(), "calls")
    known = ids.withColumnRenamed("call_id", "parent")
    edges = calls.select("call_id", F.explode("depends_on").alias("parent")).distinct().join(known, "parent", "left_semi")
    edges = written(edges.select("call_id", "parent"), "depends")
    parents = written(edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("parent").alias("parent")), "parents")
    single = parents.where("n = 1").select("call_id", "parent")
    roots = ids.join(parents, "call_id", "left_anti")
    chains = _chains(single)
    settled = roots.select("call_id", F.lit(0).alias("level"))
    if parents.where("n > 1").limit(1).count():
        several = parents.where("n > 1").select("call_id")
        ends = chains.select(F.col("call_id").alias("parent"), "anchor", "dist").unionAll(roots.unionAll(several).select(F.col("call_id").alias("parent"), F.col("call_id").alias("anchor"), F.lit(0).alias("dist")))
        into = edges.join(several, "call_id", "left_semi").join(ends, "parent", "left").select("call_id", "anchor", (F.col("dist") + 1).alias("weight"))
        settled = settled.unionAll(_junctions(written(into, "junctions"), roots))
    above = settled.select(F.col("call_id").alias("anchor"), F.col("level").alias("from"))
    return settled.unionAll(chains.join(above, "anchor").select("call_id", (F.col("from") + F.col("dist")).alias("level")))


def errors(arguments: Column, name: Column, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> Column:
    """What is wrong with arguments (JSON) of a tool, sorted; ``schemas``: tool -> argument -> (type, whether required)."""
    parsed = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))
    keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
    out = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = [F.when(~is_object, F.lit("not an object"))]
        for field, (kind, required) in fields.items():
            here = F.array_contains(keys, field)
            fits = F.coalesce(F.schema_of_variant(F.try_variant_get(parsed, f"$.{field}", "variant")).rlike(f"^({TYPES[kind]})$"), F.lit(False))
            found.append(F.when(is_object & here & ~fits, F.lit(f"{field}: not {kind}")))
            if required:
                found.append(F.when(is_object & ~here, F.lit(f"{field}: missing")))
        names = F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")
        extra = F.transform(F.array_sort(F.array_except(keys, names)), lambda k: F.concat(k, F.lit(": unknown")))
        out = F.when(name == tool, F.concat(F.array_compact(F.array(*found)), extra)).otherwise(out)
    return F.array_sort(out)


def format_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, tuple[str, bool]]]) -> DataFrame:
    """Linked, ordered, validated and serialised ``calls`` (call_id, name, arguments, depends_on, ...)."""
    out = link(calls, results).join(levels(calls), "call_id", "left")
    out = out.withColumn("errors", errors(F.col("arguments"), F.col("name"), schemas)).withColumn("valid", F.size("errors") == 0)
    arguments = F.coalesce(canonical("arguments"), F.to_json(F.struct(F.col("arguments").alias("text"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).cast("string").alias("x")), {"ignoreNullFields": "false"}), r"(?s)^\{\"x\":(.*)\}$", 1)
    return out.withColumn("json", F.concat(F.lit('{"arguments":'), arguments, F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("name"), F.lit(',"result":'), quoted("result"), F.lit("}")))


#: In plain conversations a user's turn is a call of this tool, and the next turn of the assistant its result.
ASK = {"ask": {"n_chars": ("integer", True), "text": ("string", True)}}


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of ``turns`` (conv_id, turn, role, text): a question depends on the conversation's last one."""
    turns = turns.select("conv_id", "turn", "role", "text")
    named = lambda back: F.concat_ws(":", *(F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), c) for c in (F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string"))))
    key = lambda back: F.nullif(named(back), F.lit(""))
    arguments = F.to_json(F.struct(F.length("text").alias("n_chars"), "text"))
    calls = turns.where("role = 'user'").select("conv_id", "turn", key(0).alias("call_id"), F.lit("ask").alias("name"), arguments.alias("arguments"), F.array_compact(F.array(key(2))).alias("depends_on"))
    results = turns.where("role = 'assistant'").select(key(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def turn_rows(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, kind, call_id, linked, json`` of every turn: none is left out.

    A user's turn is a ``call``, an assistant's a ``result`` of the call one turn before; other turns (a system's, those
    without a role) are ``text``. ``call_id`` is the call that a turn is or answers, null for text and for turns without
    a conversation or number; ``linked`` says whether the other side of the call is there. ``json`` is the turn's message
    with sorted keys. Repeated turns have a row each.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    kind = F.when(F.col("role") == "user", "call").when(F.col("role") == "assistant", "result").otherwise("text")
    own = lambda back: F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.concat_ws(":", F.col("conv_id").cast("string"), (F.col("turn") - back).cast("string")))
    rows = turns.withColumn("kind", kind).withColumn("call_id", F.when(F.col("kind") == "call", own(0)).when(F.col("kind") == "result", own(1)))
    sides = rows.where("call_id is not null").groupBy("call_id").agg((F.count_if(F.col("kind") == "call") > 0).alias("called"), (F.count_if(F.col("kind") == "result") > 0).alias("answered"))
    linked = F.when(F.col("kind") == "call", F.col("answered")).when(F.col("kind") == "result", F.col("called"))
    message = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    return rows.join(sides, "call_id", "left").select("conv_id", "turn", "role", "kind", "call_id", F.coalesce(linked, F.lit(False)).alias("linked"), message.alias("json"))


TURNS_SQL = """
with t as (select conv_id, turn, role, text, case role when 'user' then 'call' when 'assistant' then 'result' else 'text' end as kind,
  case role when 'user' then conv_id || ':' || turn when 'assistant' then conv_id || ':' || (turn - 1) end as call_id from conversations)
select conv_id, turn, role, kind, call_id,
  coalesce(case kind when 'call' then call_id in (select call_id from t where kind = 'result' and call_id is not null) when 'result' then call_id in (select call_id from t where kind = 'call' and call_id is not null) end, false) as linked,
  '{"content":' || coalesce(to_json(text)::varchar, 'null') || ',"role":' || coalesce(to_json(role)::varchar, 'null') || '}' as json from t
"""

#: The same over the table ``conversations``; questions follow one another at a distance of two turns.
SQL = """
with calls as (select conv_id, turn, conv_id || ':' || turn as call_id, text from conversations where role = 'user'),
results as (select conv_id || ':' || (turn - 1) as call_id, count(*) as n_results, min(turn) as result_turn, arg_min(text, (turn, text)) as result
            from conversations where role = 'assistant' group by 1),
apart as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as island from (select distinct conv_id, turn, call_id from calls)),
levels as (select call_id, row_number() over (partition by conv_id, turn % 2, island order by turn) - 1 as level from apart)
select c.conv_id, c.turn, c.call_id, l.level::int as level, coalesce(r.n_results, 0)::bigint as n_results, r.result_turn, c.text is not null as valid,
  '{"arguments":' || case when c.text is null then '{}' else json_object('n_chars', length(c.text), 'text', c.text) end || ',"id":' || to_json(c.call_id) || ',"name":"ask","result":' || coalesce(to_json(r.result)::varchar, 'null') || '}' as json
from calls c left join results r using (call_id) left join levels l using (call_id)
"""
