"""Quality rules as a bitmask ledger.

Every document is measured once and every rule is evaluated once; the ledger keeps the measurements and one bit for
each failed rule. A policy is a versioned set of rules: applying it, or asking what each of its rules does alone, reads
bits and never the texts again.

Null and empty texts have no words and fail ``few_words``; repeated rows give repeated rows. Very long texts are measured
whole, one at a time. Empty tables give an empty ledger and an ablation without rows. There are no ties: every rule is
judged on its own. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch_from, id_and_text, written

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_capitals")
_SCHEMA = "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES)
WINDOW = 8

#: The bit of a rule is its place here; new rules go to the end, so old ledgers stay readable.
RULES: dict[str, Column | str] = {
    "few_words": "n_words < 20",
    "repeated_words": "100 * n_repeat_words > 30 * n_words",
    "many_symbols": "4 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2",
    "word_length": "word_chars < 2 * n_words or word_chars > 40 * n_words",
    "capitals": "2 * n_capitals > n_letters and n_letters > 100",
}
BASE = ("few_words", "repeated_words")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "many_symbols", "duplicate_lines", "word_length"),
    "v2": (*BASE, "many_symbols", "duplicate_lines", "word_length", "capitals"),
}


def repeated(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that come twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    codes = np.array([number.setdefault(w, len(number)) for w in words], "u8")
    mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    hashed = np.zeros(n, "u8")
    for k in range(WINDOW):
        hashed = hashed * np.uint64(0xBF58476D1CE4E5B9) + mixed[k : k + n]
    ranked = np.sort(hashed)
    if not (same := ranked[1:] == ranked[:-1]).any():
        return 0
    where: dict[tuple, list[int]] = {}
    codes = codes.tolist()
    for i in np.flatnonzero(np.isin(hashed, ranked[1:][same])).tolist():  # equal hashes are compared word by word
        where.setdefault(tuple(codes[i : i + WINDOW]), []).append(i)
    step = np.zeros(len(words) + 1, "i8")
    for places in where.values():
        if len(places) > 1:
            at = np.array(places)
            np.add.at(step, at, 1)
            np.add.at(step, at + WINDOW, -1)
    return int((np.cumsum(step) > 0).sum())


def _count(data: bytes, drop: bytes) -> int:
    return len(data) - len(data.translate(None, drop))


_CAPITALS, _CONTINUED = bytes(range(65, 91)), bytes(range(128, 192))
_ASCII_LETTERS = _CAPITALS + bytes(range(97, 123))


def measure_text(text: str) -> tuple[int, ...]:
    """MEASURES of one text; letters and capitals are those of the basic Latin alphabet."""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: splits at the six white-space characters of ASCII alone
    lines = [x for x in data.split(b"\n") if x.strip()]
    chars = sum(map(len, words)) - _count(data, _CONTINUED)
    return len(words), chars, _count(data, b"#*$%&|<>"), len(lines) - len(set(lines)), repeated(words), len(lines), _count(data, _ASCII_LETTERS), _count(data, _CAPITALS)


def _measure(batches):
    for batch in batches:
        rows = [measure_text(t) for t in batch.column("text").to_pylist()]
        if rows:
            yield batch_from(_SCHEMA, doc_id=batch.column("doc_id"), **dict(zip(MEASURES, map(pa.array, zip(*rows, strict=True)), strict=True)))


def ledger(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """``doc_id``, the measurements and ``failures``, a bit for each failed rule."""
    measured = id_and_text(docs).mapInArrow(_measure, _SCHEMA)
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(rules.values())]
    return measured.withColumn("failures", sum(bits, F.lit(0)).cast("long"))


def mask(names: tuple[str, ...], rules: dict[str, str] = RULES) -> int:
    """The bits of some rules."""
    return sum(1 << [*rules].index(name) for name in names)


def fails(policy: str) -> Column:
    """Whether a row of the ledger fails any rule of a policy."""
    return F.col("failures").bitwiseAND(F.lit(mask(POLICIES[policy]))) != 0


def ablation(entries: DataFrame, policy: str) -> DataFrame:
    """Per rule of a policy: documents that fail it, and those that only it rejects (kept if the rule were left out).

    The ledger is summed up by failure bits first, so at most 2^rules rows go on.
    """
    bits = mask(POLICIES[policy])
    summed = entries.groupBy(F.col("failures").bitwiseAND(F.lit(bits)).alias("bits")).agg(F.count("*").alias("n"))
    parts = [F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).cast("long").alias("bit")) for r in POLICIES[policy]]
    each = summed.select("bits", "n", F.explode(F.array(*parts)).alias("r")).select("bits", "n", "r.*")
    return each.groupBy("rule").agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(F.col("bits") != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )


def verdicts(docs: DataFrame, policy: str = "v2") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept`` of a policy (which holds the base rules)."""
    return ledger(docs).withColumns({"base_failed": fails("base"), "kept": ~fails("base") & ~fails(policy)})


def ablations(docs: DataFrame) -> DataFrame:
    """``policy, rule, n_failed, n_only, n_rejected`` of every policy's rules: the texts are read once, for the ledger."""
    entries = written(ledger(docs).select("failures"), "ledger")
    out = None
    for policy in POLICIES:
        rows = ablation(entries, policy).select(F.lit(policy).alias("policy"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


#: ``n_repeat_words`` by counting every window's text; the verdict's other rules as in RULES and POLICIES["v2"].
_MEASURED = r"""
with d as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
w as (select row, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
win as (select row, i, array_to_string(ws[i:i + 7], ' ') as g from w, unnest(range(1, len(ws) - 6)) t(i)),
dup as (select row, i from (select row, i, count(*) over (partition by row, g) as c from win) where c > 1),
rep as (select row, count(distinct i + k) as n from dup, range(8) r(k) group by row),
m as (select w.doc_id, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines,
        (length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g')))::bigint as n_letters,
        (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_capitals
      from w left join rep using (row))
"""
SQL = _MEASURED + r"""select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  not (n_words < 20 or 100 * n_repeat_words > 30 * n_words or 4 * n_symbols > n_words or (10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2)
    or word_chars < 2 * n_words or word_chars > 40 * n_words or (2 * n_capitals > n_letters and n_letters > 100)) as kept
from m
"""

_FAILED = {
    "few_words": "n_words < 20", "repeated_words": "100 * n_repeat_words > 30 * n_words", "many_symbols": "4 * n_symbols > n_words", "duplicate_lines": "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2",
    "word_length": "word_chars < 2 * n_words or word_chars > 40 * n_words", "capitals": "2 * n_capitals > n_letters and n_letters > 100",
}


def _ablation_sql() -> str:
    """Each rule judged on its own, without bits; a rule alone rejects what no other rule of its policy does."""
    rows = []
    for policy, names in POLICIES.items():
        any_of = " or ".join(f"({_FAILED[r]})" for r in names)
        for r in names:
            others = " or ".join(f"({_FAILED[o]})" for o in names if o != r)
            rows.append(f"select '{policy}' as policy, '{r}' as rule, count(*) filter ({_FAILED[r]}) as n_failed, count(*) filter (({_FAILED[r]}) and not ({others})) as n_only, count(*) filter ({any_of}) as n_rejected from m")
    return _MEASURED + " union all ".join(rows)


ABLATION_SQL = _ablation_sql()
