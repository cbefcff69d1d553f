"""Merkle dataset manifest: a binary tree of row digests for each language, and one over the languages.

Exact ranks come without a global sort. A row's sort key is a string of digits (its id's, then its digest's). Keys are
counted by their leading digits, at a depth at which no prefix has more than ``BUCKET`` keys; the counts are added up to
shorter and shorter prefixes, and running sums go back down: inside a prefix over its 4,096 next digits, never over a
whole language. So each prefix knows how many keys come before it, and rows are ordered inside a prefix alone.

A node of the tree is named by its language and the leading binary digits of its leaves' ranks. Nodes are reduced from the longest
prefix to the shortest, ten digits at a time: a task sees the 1,024 nodes of a prefix at most. Siblings on the way to
the root come back down the same way, a row for each node, until they meet the leaves.

* Each column but ``doc_id, source, lang, n_chars, text`` is left out; nulls are written as ``-``.
* Null ids come first in their language; rows of one language and id are ordered by their digests. Rows that are equal
  altogether are counted as one until they have ranks, and have a leaf each.
* A null language is a tree of its own, the first one. Empty and very long texts are texts like any other.
* An empty table has an empty result.
"""

from __future__ import annotations

import os
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.llm.common import batch_of, written

#: Hexadecimal digits and keys of a bucket; binary digits of a reduction; copies that are numbered at once.
DIGITS, BUCKET, BITS, COPIES = 3, 4096, 10, 4096
_PATH = "g string, i long, path array<string>, subroot string, root string"


def _field(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c))


def leaf(n_chars: Column) -> Column:
    """A row's digest, with ``n_chars`` in place of its own."""
    return F.sha2(F.concat(*(_field(c.cast("string")) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))), 256)


def digits(c: str) -> Column:
    """A string's bytes as digits that sort as it does, null first."""
    return F.when(F.col(c).isNull(), "0").otherwise(F.concat(F.lit("1"), F.hex(F.encode(F.col(c), "UTF-8"))))


def ranked(items: DataFrame, carry: list[str]) -> DataFrame:
    """``g, carry, n, first, total``: the rank of each item (g, key, n: so many copies) in its group, and the group's size.

    Keys are distinct in a group; a group is in no task as a whole.
    """
    ends = items.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.max(F.length("key")).alias("long")).first()
    if ends.a is None:
        return items.select("g", *carry, "n", F.lit(0).cast("long").alias("first"), F.lit(0).cast("long").alias("total"))
    top = depth = len(os.path.commonprefix([ends.a, ends.b]))
    while True:
        depth += DIGITS
        counts = items.groupBy("g", F.substring("key", 1, depth).alias("p")).agg(F.count("*").alias("keys"), F.sum("n").alias("n"))
        if depth >= ends.long or counts.agg(F.max("keys")).first()[0] <= BUCKET:
            break
    counts = written(counts, "digits")
    levels = [counts.select("g", "p", "n")]
    for d in range(depth - DIGITS, top - 1, -DIGITS):
        levels.append(levels[-1].groupBy("g", F.substring("p", 1, d).alias("p")).agg(F.sum("n").alias("n")))
    known = levels.pop().select("g", "p", F.lit(0).cast("long").alias("before"), F.col("n").alias("total"))
    while levels:
        below = levels.pop()
        shorter = depth - DIGITS * (len(levels) + 1)
        inside = Window.partitionBy("g", "above").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
        below = below.withColumn("above", F.substring("p", 1, shorter)).withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        known = below.join(known.withColumnRenamed("p", "above"), ["g", "above"]).select("g", "p", (F.col("before") + F.col("inside")).alias("before"), "total")
    known = written(known, "offsets")
    ordered = Window.partitionBy("g", "p").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    placed = items.withColumn("p", F.substring("key", 1, depth)).join(known, ["g", "p"])
    return placed.select("g", *carry, "n", (F.col("before") + F.coalesce(F.sum("n").over(ordered), F.lit(0))).alias("first"), "total")


def _single(rows: DataFrame) -> DataFrame:
    """A row for each copy, with its rank ``i``; the copies of one row are numbered by many tasks."""
    alone = rows.where("n = 1").withColumn("i", F.col("first"))
    many = rows.where("n > 1").withColumn("at", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition("g", "first", "at")
    many = many.withColumn("i", F.explode(F.expr(f"sequence(first + at, first + least(at + {COPIES}, n) - 1)"))).drop("at")
    return alone.unionByName(many).drop("n", "first")


def _h(*texts: str) -> str:
    return sha256("".join(texts).encode()).hexdigest()


def _levels(total: int, done: int) -> int:
    """Levels that a step reduces where ``done`` are reduced already."""
    return max(0, min(BITS, (total - 1).bit_length() - done))


def _tree(start: int, hashes: list[str], levels: int) -> list[list[str]]:
    """Nodes by level over consecutive leaves, of which the first has the index ``start``, a multiple of 2 ** levels."""
    out = [hashes]
    for _ in range(levels):
        last = out[-1]
        out.append([_h(*last[k : k + 2]) for k in range(0, len(last), 2)])
    return out


def _paths(tree: list[list[str]]) -> list[list[str]]:
    """For each leaf its siblings from below: side and digest, or ``-`` where a node has none."""
    above: list[list[str]] = [[]]
    for level in reversed(tree[:-1]):
        own = []
        for k in range(len(level)):
            beside = k ^ 1
            own.append([("<" if k & 1 else ">") + level[beside] if beside < len(level) else "-", *above[k >> 1]])
        above = own
    return above


def fold(digest: str, path: list[str]) -> str:
    """The root that a digest and its siblings lead to."""
    for step in path:
        digest = _h(digest) if step == "-" else _h(step[1:], digest) if step[0] == "<" else _h(digest, step[1:])
    return digest


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("i")


def _up(done: int):
    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        g, total, first = table.column("g")[0].as_py(), table.column("total")[0].as_py(), table.column("i")[0].as_py()
        levels = _levels(total, done)
        root = _tree(first, table.column("leaf").to_pylist(), levels)[-1][0]
        return pa.Table.from_batches([batch_of("g string, i long, leaf string, total long", [(g, first >> BITS, root, total)])])

    return run


def _down(done: int):
    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = _ordered(nodes)
        g, total, first = nodes.column("g")[0].as_py(), nodes.column("total")[0].as_py(), nodes.column("i")[0].as_py()
        path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
        found = _paths(_tree(first, nodes.column("leaf").to_pylist(), _levels(total, done)))
        return pa.Table.from_batches([batch_of(_PATH, [(g, first + k, [*own, *path], subroot, root) for k, own in enumerate(found)])])

    return run


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
    nodes = _ordered(nodes)
    path, subroot, root = (above.column(c)[0].as_py() for c in ("path", "subroot", "root"))
    leaves = nodes.column("leaf").to_pylist()
    found = _paths(_tree(nodes.column("i")[0].as_py(), leaves, _levels(nodes.column("total")[0].as_py(), 0)))
    rows = []
    for doc_id, own, tampered, siblings in zip(nodes.column("doc_id").to_pylist(), leaves, nodes.column("tampered").to_pylist(), found, strict=True):
        way = [*siblings, *path]
        folded = fold(tampered or own, way)
        rows.append((doc_id, own, subroot, root, _h(*(s[1:] for s in way)), folded, folded == root))
    return pa.Table.from_batches([batch_of(_PROVED, rows)])


def _block(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.shiftright("i", BITS))


def reduced(nodes: DataFrame) -> list[DataFrame]:
    """Nodes (g, i, leaf, total) by step: the given ones first, a root for each group (of index 0) last."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    steps = [nodes]
    for done in range(0, (most - 1).bit_length() if most > 1 else 0, BITS):
        up = _block(steps[-1].select("g", "i", "leaf", "total")).groupBy("g", "block").applyInArrow(_up(done), "g string, i long, leaf string, total long")
        steps.append(written(up, "nodes"))
    return steps


def _met(nodes: DataFrame, above: DataFrame, run, schema: str) -> DataFrame:
    return _block(nodes).groupBy("g", "block").cogroup(above.withColumn("block", F.col("i")).groupBy("g", "block")).applyInArrow(run, schema)


def returned(steps: list[DataFrame], above: DataFrame, least: int = 0) -> DataFrame:
    """``g, i, path, subroot, root`` of the nodes of step ``least``, from those of the roots (``above``)."""
    for k in range(len(steps) - 2, least - 1, -1):
        above = written(_met(steps[k].select("g", "i", "leaf", "total"), above, _down(k * BITS), _PATH), "paths")
    return above


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row; see the module.

    Where 7 divides the crc32 of an id, ``folded_root`` starts from the digest of the row with one character more in
    ``n_chars``.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("decimal(20,0)")
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, leaf(more))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digits("lang").alias("g"), leaf(F.col("n_chars")).alias("leaf"), wrong.alias("tampered"))
    number = F.lpad(F.hex(F.col("doc_id").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    key = F.concat(F.when(F.col("doc_id").isNull(), "0").otherwise(F.concat(F.lit("1"), number)), "leaf")
    items = written(rows.groupBy("g", "doc_id", "leaf").agg(F.first("tampered").alias("tampered"), F.count("*").alias("n")).withColumn("key", key), "leaves")
    leaves = written(_single(ranked(items, ["doc_id", "leaf", "tampered"])), "ranked")

    steps = reduced(leaves)
    roots = written(ranked(steps[-1].select(F.lit("").alias("g"), F.col("g").alias("key"), F.lit(1).cast("long").alias("n"), "leaf"), ["key", "leaf"]), "roots")
    top = reduced(roots.select("g", F.col("first").alias("i"), "leaf", "total"))
    root = top[-1].select("g", "i", F.array().cast("array<string>").alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("leaf").alias("root"))
    over = returned(top, root)
    own = roots.select("key", "leaf", F.col("first").alias("i")).join(over.select("i", "path", "root"), "i")
    above = own.select(F.col("key").alias("g"), F.lit(0).cast("long").alias("i"), "path", F.col("leaf").alias("subroot"), "root")
    if len(steps) == 1:  # every language has one leaf at most: the roots are the leaves
        return _met(leaves, above, _prove, _PROVED)
    return _met(leaves, returned(steps, above, 1), _prove, _PROVED)


def _crc32(text: str) -> str:
    """CRC-32 of a short ASCII string in DuckDB SQL, bit by bit."""
    step = "list_reduce(list_prepend(xor(c, x), [0::UBIGINT, 1, 2, 3, 4, 5, 6, 7]), lambda a, b: xor(a >> 1, CASE WHEN a & 1 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))"
    return f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split({text}, ''), lambda s: ascii(s)::UBIGINT)), lambda c, x: {step}), 4294967295::UBIGINT)"


def _sql(levels: int = 40) -> str:
    """The manifest in DuckDB SQL: nodes by level by recursion, then each leaf's way up."""
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END"
    row = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"
    return f"""
WITH RECURSIVE leaves AS MATERIALIZED (
  SELECT doc_id, lang, leaf, total, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
    CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN wrong ELSE leaf END AS given
  FROM (SELECT doc_id, lang, {row("n_chars")} AS leaf, {row("(n_chars + 1)")} AS wrong, count(*) OVER (PARTITION BY lang) AS total FROM documents)),
nodes AS (
  SELECT 0 AS level, lang, i, leaf AS h, total AS n FROM leaves
  UNION ALL
  SELECT level + 1, lang, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM nodes WHERE n > 1 GROUP BY level, lang, i // 2),
tree AS MATERIALIZED (SELECT * FROM nodes),
subroots AS MATERIALIZED (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, subroot AS h, n FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 1) // 2) FROM tops WHERE n > 1 GROUP BY level, i // 2),
top AS MATERIALIZED (SELECT * FROM tops),
way AS MATERIALIZED (
  SELECT 0 AS part, t.level, t.lang, t.i, t.i & 1 AS side, b.h FROM tree t LEFT JOIN tree b ON b.level = t.level AND b.lang IS NOT DISTINCT FROM t.lang AND b.i = xor(t.i, 1) WHERE t.n > 1),
above AS MATERIALIZED (
  SELECT s.lang, list({{'side': (s.i >> t.level) & 1, 'h': b.h}} ORDER BY t.level) AS steps
  FROM subroots s JOIN (SELECT DISTINCT level FROM top WHERE n > 1) t ON true LEFT JOIN top b ON b.level = t.level AND b.i = xor(s.i >> t.level, 1)
  GROUP BY s.lang),
steps AS (
  SELECT l.lang, l.i, list({{'side': w.side, 'h': w.h}} ORDER BY w.level) AS steps
  FROM leaves l JOIN way w ON w.lang IS NOT DISTINCT FROM l.lang AND w.i = l.i >> w.level GROUP BY l.lang, l.i),
ways AS (
  SELECT l.doc_id, l.leaf, l.given, s.subroot, (SELECT h FROM top WHERE n = 1) AS root, list_concat(coalesce(p.steps, []), coalesce(a.steps, [])) AS steps
  FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang LEFT JOIN steps p ON p.lang IS NOT DISTINCT FROM l.lang AND p.i = l.i LEFT JOIN above a ON a.lang IS NOT DISTINCT FROM l.lang),
folded AS (
  SELECT *, list_reduce(list_prepend({{'side': 0::BIGINT, 'h': given}}, steps), lambda a, s: {{'side': 0::BIGINT, 'h': sha256(CASE WHEN s.h IS NULL THEN a.h WHEN s.side = 1 THEN s.h || a.h ELSE a.h || s.h END)}}).h AS folded_root FROM ways)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_filter(list_transform(steps, lambda s: s.h), lambda h: h IS NOT NULL), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM folded
"""


SQL = _sql()
