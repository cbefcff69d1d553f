"""Vector code compression: four 256-entry codebooks by a Lloyd iteration that moves only what has changed.

Each round a table keeps every vector's assignment and the one before it. Only parts whose assignment changed give
contributions: their components are added to the new entry's sums and taken from the old one's. Contributions are added
up inside a task first (1,024 sums at most), then shuffled by part and entry and added to the running integer sums,
which are a table of their own. All arithmetic is on integers, so neither order nor partitions change a result.

What is broadcast and collected is the codebook: 1,024 entries of a quarter vector each.

* Null vectors and vectors with null or non-finite components are dropped.
* Vectors that are shorter than the longest, or not a multiple of four long, are filled up with zeros at the end.
* Components are held within +-2**26 after scaling (65,536 before), so that distances stay exact 64-bit integers.
* Null vec_ids stay, and come after all others when the first codebook is chosen; equal vec_ids are told apart by their
  vectors. Repeated rows are rows like any other. With fewer than 256 vectors a codebook has as many entries.
* An empty table has an empty result. Other columns are left out.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.common import forget, sliced, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Bound of a component's size; rows of a batch, so that its distances are 8 MB.
MOST, ROWS = 1 << 26, 4096


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(-1, width)


def _fixed(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one binary value."""
    data, size = np.ascontiguousarray(rows), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(0, size * len(rows) + 1, size, dtype="<i4")), pa.py_buffer(data)])


def _whole(width: int):
    """Integer vectors of ``width`` components, as bytes."""

    def run(batches):
        for batch in batches:
            for part in sliced([batch], ROWS):
                found = part.column("embedding")
                sizes = np.asarray(found.value_lengths()).astype("i8")
                out = np.zeros((len(sizes), width), "<i4")
                values = np.asarray(found.flatten()).astype("f8")
                at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                out[np.repeat(np.arange(len(sizes)), sizes), at] = np.clip(np.floor(SCALE * values), -MOST, MOST)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("label"), _fixed(out), pa.nulls(len(out), pa.binary())], names=["vec_id", "label", "x", "code"])

    return run


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of each row's nearest entry (the lower of equals) and the squared distance, exact."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(book).max(initial=0)), 1)
    kind = "f8" if 4 * most * most * x.shape[1] < 1 << 53 else "i8"
    x, book = x.astype(kind), book.astype(kind)
    beyond = (book * book).sum(1) - 2 * (x @ book.T)
    found = beyond.argmin(1)
    return found, ((x * x).sum(1) + beyond[np.arange(len(x)), found]).astype("i8")


def _assign(books: np.ndarray):
    """New codes beside the ones before."""
    parts, _, width = books.shape

    def run(batches):
        for batch in sliced(batches, ROWS):
            x = _matrix(batch.column("x"), parts * width)
            codes = np.stack([nearest(x[:, p * width : (p + 1) * width], books[p])[0] for p in range(parts)], 1).astype("u1")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "x")), _fixed(codes), batch.column("code")], names=["vec_id", "label", "x", "code", "before"])

    return run


def _changes(parts: int, entries: int, width: int):
    """A task's sums of what its changed assignments add to entries and take from them."""

    def run(batches):
        sums, counts = np.zeros((parts * entries, width), "i8"), np.zeros(parts * entries, "i8")
        for batch in sliced(batches, ROWS):
            x, code = _matrix(batch.column("x"), parts * width), np.frombuffer(b"".join(batch.column("code").to_pylist()), "u1").reshape(-1, parts).astype("i8")
            given = [b if b is not None else bytes(parts) for b in batch.column("before").to_pylist()]
            before = np.frombuffer(b"".join(given), "u1").reshape(-1, parts).astype("i8")
            had = ~np.asarray(batch.column("before").is_null())
            for p in range(parts):
                own, moved = x[:, p * width : (p + 1) * width], ~had | (before[:, p] != code[:, p])
                for sign, entry, rows in ((1, code[:, p], moved), (-1, before[:, p], moved & had)):
                    np.add.at(sums, p * entries + entry[rows], sign * own[rows].astype("i8"))
                    np.add.at(counts, p * entries + entry[rows], sign)
        some = np.nonzero(counts.astype(bool) | sums.any(1))[0]
        columns = [some // entries, some % entries, counts[some], *sums[some].T]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["part", "entry", "n", *(f"c{i}" for i in range(width))])

    return run


def _errors(books: np.ndarray):
    parts, _, width = books.shape

    def run(batches):
        for batch in sliced(batches, ROWS):
            x = _matrix(batch.column("x"), parts * width)
            found = [nearest(x[:, p * width : (p + 1) * width], books[p]) for p in range(parts)]
            codes = np.stack([c for c, _ in found], 1).astype("u1")
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(e for _, e in found), pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def _updated(books: np.ndarray, rows: list) -> np.ndarray:
    out = books.copy()
    for r in rows:
        if r.n:
            out[r.part, r.entry] = np.array(r[3:]) // r.n
    return out


def fit(whole: DataFrame, first: list[bytes], width: int, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[DataFrame, np.ndarray]:
    """The table of vectors with their last assignments, and the codebooks (part, entry, component)."""
    books = np.stack([np.frombuffer(x, "<i4").reshape(parts, width) for x in first], 1).astype("i8")
    schema = T.StructType([*whole.schema.fields[:3], T.StructField("code", T.BinaryType()), T.StructField("before", T.BinaryType())])
    names = [f"c{i}" for i in range(width)]
    sums = None
    for _ in range(rounds):
        after = written(whole.mapInArrow(_assign(books), schema), "codes")
        forget(whole)
        whole = after
        moved = whole.where("before is null or before != code").select("x", "code", "before")
        changes = moved.mapInArrow(_changes(parts, books.shape[1], width), ", ".join(f"{c} long" for c in ("part", "entry", "n", *names)))
        every = changes if sums is None else changes.unionAll(sums)
        added = written(every.groupBy("part", "entry").agg(*(F.sum(c).alias(c) for c in ("n", *names))), "sums")
        if sums is not None:
            forget(sums)
        sums, last = added, books
        books = _updated(books, sums.collect())  # a row for each part and entry
        if (books == last).all():  # then nothing moves any more
            break
    return whole, books


def encode(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of rows (vec_id, embedding, label); see the module."""
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding")).where(F.col("embedding").isNotNull() & ~odd)
    width = max(1, -(-(kept.agg(F.max(F.size("embedding"))).first()[0] or 0) // PARTS))
    kinds = [T.StructField(c, vectors.schema[c].dataType) for c in ("vec_id", "label")]
    whole = written(kept.mapInArrow(_whole(PARTS * width), T.StructType([*kinds, T.StructField("x", T.BinaryType()), T.StructField("code", T.BinaryType())])), "vectors")
    first = [r.x for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()]
    if not first:
        return whole.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit(sha256(b"").hexdigest()).alias("codebooks_sha256"))
    whole, books = fit(whole, [bytes(x) for x in first], width, rounds)
    coded = written(whole.mapInArrow(_errors(books), T.StructType([*kinds, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])), "coded")
    forget(whole)
    by_label = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    digest = sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _sql(rounds: int = ROUNDS) -> str:
    """The iteration as DuckDB SQL, a pair of subqueries a round."""
    book = """book{r} AS MATERIALIZED (SELECT p, e, x, list_inner_product(x, x) AS xx FROM ({of}))"""
    code = """code{r} AS MATERIALIZED (SELECT vec_id, p, min(CAST(a.xx - 2 * list_inner_product(a.x, b.x) + b.xx AS BIGINT) * 256 + b.e) AS de FROM parts a JOIN book{r} b USING (p) GROUP BY vec_id, p)"""
    mean = """SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{q} b LEFT JOIN (
      SELECT p, e, list(v ORDER BY i) AS x FROM (
        SELECT p, de % 256 AS e, i, floor(sum(x[i]) / count(*)) AS v FROM parts JOIN code{q} USING (vec_id, p), generate_series(1, (SELECT w FROM width)) g(i) GROUP BY ALL) GROUP BY p, e) m USING (p, e)"""
    first = "SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)"
    steps = [book.format(r=0, of=first), code.format(r=0)]
    for r in range(1, rounds + 1):
        steps += [book.format(r=r, of=mean.format(q=r - 1)), code.format(r=r)]
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
width AS (SELECT max(len(v)) // 4 AS w FROM kept),
parts AS MATERIALIZED (
  SELECT vec_id, p, x, list_inner_product(x, x) AS xx FROM (
    SELECT vec_id, p, v[CAST(p * w + 1 AS BIGINT) : CAST(p * w + w AS BIGINT)] AS x FROM kept, width, range(4) g(p))),
{", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', CAST(de % 256 AS INTEGER)), '' ORDER BY p) AS code, CAST(sum(de // 256) AS BIGINT) AS error FROM code{rounds} GROUP BY vec_id),
digest AS (SELECT sha256(string_agg(s, ',' ORDER BY p, e)) AS codebooks_sha256 FROM (
  SELECT p, e, array_to_string(list_transform(x, lambda v: CAST(CAST(v AS BIGINT) AS VARCHAR)), ',') AS s FROM book{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (vec_id), digest
"""


SQL = _sql()
