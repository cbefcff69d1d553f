"""Suffix-array deduplication of passages: bytes that a repeated string of LENGTH bytes covers.

Suffixes are range-partitioned by their leading bytes with sampled splitters, every bucket sorts its own by multikey
quicksort, and equal neighbours are repeats; what stands at a bucket's ends is compared across the boundary. Ties are
split between buckets, so a passage in a third of all documents fills many buckets evenly.

Not every suffix needs to be sorted. Every string of LENGTH bytes has an anchor, its least GRAM-byte hash (the last
such), that depends on its bytes alone: equal strings have equal anchors at equal offsets. So three levels suffice:

1. Runs: neighbouring strings with one anchor, sorted by the anchor's suffix (leading bytes, gram, whole context). An
   anchor that comes once has no repeats. Runs with equal contexts repeat as a whole.
2. Blocks: where runs share an anchor but differ, one run of each context, in blocks of STEP strings, sorted by the bytes
   that all of a block's strings have (core) and by all their bytes. Equal blocks repeat as a whole.
3. Strings: where blocks share a core but differ, one block of each kind, string by string.

A string's bytes are compared as its eight leading bytes and digests of 64 (the anchor) and 96 bits (the whole).

Null, empty and short texts have no string of LENGTH bytes and lose nothing. Of repeated rows every one is a repeat of
the others, and one of them stands for all in the search. Very long texts are taken in segments. Equal strings in one
text are repeats too, and overlaps count; no match goes from one text into another. Tables without rows give none.
Clashing columns: ``digests`` reads doc_id and text alone, ``without_repeats`` carries all others in a struct.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideline.llm.common import arrow_schema, batch_of, id_and_text, text_key, unwrapped, wrapped, written
from tideline.llm.hashing import digests as digests_of
from tideline.llm.hashing import eights, grams, number

#: Bytes of a repeated string, of an anchor; strings of a block; rows of a bucket at most, about; rows that a task sorts
#: at least, if there are tasks for all cores.
LENGTH, GRAM, STEP, BUCKET, TASK = 400, 32, 16, 1_000_000, 250_000
#: Strings of a text that are taken at a time (their places tell ties apart, in 24 bits).
SEGMENT = 1 << 23
#: Keys of repeated texts that are broadcast at most (twelve bytes each); more are joined by a shuffle.
SMALL = 500_000
_SORT = ("lead", "deep", "whole", "more")
_DEALT = (*_SORT, "key", "first")
_ROWS = "lead long, deep long, whole long, more int, key binary, first int, last int, anchor int"
_RANKED = _ROWS + ", flag int, deeper boolean, edge boolean"
_PLAIN, _SHARED, _REPEATED = 0, 1, 2


def _lead(eight: np.ndarray) -> np.ndarray:
    """Eight leading bytes as a signed number, so that Spark sorts it as bytes."""
    return (eight ^ np.uint64(1 << 63)).view("i8")


def _leads(data: bytes, at: np.ndarray) -> np.ndarray:
    raw, out = np.frombuffer(data, "u1"), np.zeros(len(at), "u8")
    for k in range(8):
        out = out << np.uint64(8) | raw[at + k]
    return _lead(out)


def _whole(data: bytes, starts: np.ndarray, ends: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The digest of a row's whole bytes: 96 bits as two numbers."""
    found = digests_of(data, starts, ends, tags, 12)
    return number(found[:, :8], "<i8"), number(found[:, 8:], "<i4")


def anchors(raw: np.ndarray, grams: np.ndarray, length: int) -> np.ndarray:
    """The place of the anchor of the string at each place: of the least hash's last occurrence."""
    width, n = length - GRAM + 1, len(raw) - length + 1
    low = np.uint64((1 << 24) - 1)
    ranks = grams & ~low | low - np.arange(len(grams), dtype="u8")
    padded = np.full(-(-len(ranks) // width) * width, np.iinfo("u8").max)
    padded[: len(ranks)] = ranks
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return (low - (np.minimum(back[:n], ahead[width - 1 : width - 1 + n]) & low)).astype("i8")


def runs(data: bytes, length: int):
    """lead, deep, whole, more, first, last, anchor of a text's runs."""
    parts = []
    for at in range(0, max(0, len(data) - length + 1), SEGMENT):
        raw = np.frombuffer(data, "u1")[at : at + SEGMENT + length - 1]
        eight = eights(raw)
        hashes = grams(eight, GRAM)
        place = anchors(raw, hashes, length)
        ends = np.append(np.flatnonzero(place[1:] != place[:-1]), len(place) - 1)
        first = np.append(0, ends[:-1] + 1)
        anchor = place[ends]
        parts.append((_lead(eight[anchor]), hashes[anchor].view("i8"), *_whole(data, first + at, ends + at + length, np.zeros_like(first)), first + at, ends + at, anchor + at))
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else None


def blocks(data: bytes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int):
    """The same of the blocks of some runs; ``anchor`` is that of the run."""
    low, high = (anchor - last) // STEP, (anchor - first) // STEP
    count = high - low + 1
    of = np.repeat(np.arange(len(first)), count)
    q = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + low[of]
    a, b = np.maximum(first[of], anchor[of] - STEP * q - STEP + 1), np.minimum(last[of], anchor[of] - STEP * q)
    core = anchor[of] - STEP * q
    deep = number(digests_of(data, core, core - STEP + 1 + length, q, 8), "<i8")
    return _leads(data, core), deep, *_whole(data, a, b + length, anchor[of] - a), a, b, anchor[of]


def strings(data: bytes, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, length: int):
    """The same of every string of some blocks."""
    count = last - first + 1
    of = np.repeat(np.arange(len(first)), count)
    at = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count) + first[of]
    found = digests_of(data, at, at + length, np.zeros_like(at), 20)
    return _leads(data, at), number(found[:, :8], "<i8"), number(found[:, 8:16], "<i8"), number(found[:, 16:], "<i4"), at, at, anchor[of]


def multikey_order(columns: list[np.ndarray]) -> np.ndarray:
    """The order of rows by columns: sorted by the first, and only ties go on to the next one."""
    order = np.argsort(columns[0], kind="stable")
    ranked = columns[0][order]
    for column in columns[1:]:
        tied = np.zeros(len(order), bool)
        tied[1:] |= ranked[1:] == ranked[:-1]
        tied[:-1] |= ranked[1:] == ranked[:-1]
        at = np.flatnonzero(tied)
        if not len(at):
            break
        group = np.cumsum(np.append(True, ranked[1:] != ranked[:-1]))[at]
        some = order[at]
        deeper = np.lexsort((column[some], group))
        order[at] = some[deeper]
        after = column[order]
        ranked = np.cumsum(np.append(True, (ranked[1:] != ranked[:-1]) | (tied[1:] & (after[1:] != after[:-1]))))
    return order


def _new(*columns: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether a row differs from the one before it."""
    return np.append(True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))


def _flags(lead: np.ndarray, deep: np.ndarray, *whole: np.ndarray) -> np.ndarray:
    """Of sorted rows: whether a neighbour shares the leading bytes and the deep hash, and the whole too."""
    shared = ~_new(lead, deep)[1:]
    out = np.zeros(len(lead), "i4")
    for same, flag in ((shared, _SHARED), (shared & ~_new(*whole)[1:], _REPEATED)):
        out[1:][same] = flag
        out[:-1][same] = np.maximum(out[:-1][same], flag)
    return out


def _deeper(lead: np.ndarray, deep: np.ndarray, *whole: np.ndarray) -> np.ndarray:
    """Of sorted rows: the first of each kind among rows that share leading bytes and deep hash but differ.

    Rows that reach a bucket's end may differ from those beyond it, so the first of each kind goes on there too.
    """
    new = _new(lead, deep)
    kind = new | _new(*whole)
    group = np.cumsum(new) - 1
    kinds, sizes = np.bincount(group, kind), np.bincount(group)
    open_ = np.zeros(len(sizes), bool)
    open_[[0, -1]] = True
    return kind & ((kinds > 1) | (open_ & (sizes > 1)))[group]


def _bucket(batches):
    """Sorts a bucket; gives its shared and repeated rows, and its first and last row (``edge``)."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    table = pa.Table.from_batches(parts)
    order = multikey_order([np.asarray(table.column(c)) for c in _SORT])
    sort_key = [np.asarray(table.column(c))[order] for c in _SORT]
    flag, deeper = _flags(*sort_key), _deeper(*sort_key)
    edge = np.zeros(len(flag), bool)
    edge[[0, -1]] = True
    keep = (flag == _REPEATED) | deeper | edge
    out = table.take(pa.array(order[keep])).combine_chunks()
    for name, column in (("flag", flag), ("deeper", deeper), ("edge", edge)):
        out = out.append_column(name, pa.array(column[keep]))
    yield from out.cast(arrow_schema(_RANKED)).to_batches()


def _as_neighbour(*columns: str):
    """Whether a row equals the one before it or after it; in one task, of two rows for each bucket.

    Buckets follow each other by the columns that they are dealt by, so their ends do too.
    """
    order = ", ".join(_DEALT)
    return F.coalesce(*(F.expr(f"nullif({' and '.join(f'{c} = {f}({c}) over (order by {order})' for c in columns)}, false)") for f in ("lag", "lead")), F.lit(False))


def ranked(rows: DataFrame) -> DataFrame:
    """Rows with ``flag`` 2 if another row is equal, and ``deeper`` if they stand for their kind on the next level.

    ``rows`` must be a written table: Spark reads it twice, for the splitters and for the buckets. A task sorts several
    small buckets, one after the other, and writes one file: each file costs processes that an executor starts.
    """
    spark, n = rows.sparkSession, rows.count()
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // BUCKET))
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-n // TASK))
    dealt = rows.repartitionByRange(buckets, *_DEALT).mapInArrow(_bucket, _RANKED)
    out = written(dealt.coalesce(tasks), "ranked")
    ends = out.where("edge").withColumns({"shared": _as_neighbour("lead", "deep"), "equal": _as_neighbour(*_SORT)})
    ends = ends.withColumns({"flag": F.when(F.col("equal"), _REPEATED).otherwise(F.col("flag")), "deeper": F.col("deeper") | (F.col("shared") & (F.col("flag") == _PLAIN))})
    return out.where("not edge").unionAll(ends.select(out.columns)).where((F.col("flag") == _REPEATED) | F.col("deeper")).drop("edge")


def _level(keys: list[bytes], parts: list) -> pa.RecordBatch:
    """A batch of _ROWS from what each text, by its key, has made."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    key = pa.array(keys, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), [len(p[0]) for p in parts])))
    arrays = [*map(pa.array, columns[:4]), key, *map(pa.array, columns[4:])]
    return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(arrays, arrow_schema(_ROWS), strict=True)], schema=arrow_schema(_ROWS))


def _emit(make, length: int):
    """Rows of a level from texts; ``make`` takes a text's bytes and, but on the first level, the parent rows."""

    def run(batches):
        for batch in batches:
            keys, parts, size = [], [], 0
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                row = dict(zip(batch.schema.names, row, strict=True))
                of = [np.array(row[c], "i8") for c in ("first", "last", "anchor") if c in row]
                if (made := make(row["text"].encode("utf-8", "surrogatepass"), *of, length)) is not None:
                    keys.append(row["key"])
                    parts.append(made)
                    size += len(made[0])
                if size > 100_000:
                    yield _level(keys, parts)
                    keys, parts, size = [], [], 0
            if parts:
                yield _level(keys, parts)

    return run


def _by_key(rows: DataFrame) -> DataFrame:
    """A text's parent rows together; they are at most as many as its bytes."""
    rows = rows.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "last", "anchor"))).alias("r"))
    return rows.select("key", *(F.col(f"r.{c}").alias(c) for c in ("first", "last", "anchor")))


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """``key, first, last``: places at which repeated strings begin; ``texts`` has key and text, each key once."""
    level1 = ranked(written(texts.mapInArrow(_emit(runs, length), _ROWS), "runs"))
    shared = written(texts.join(_by_key(level1.where("deeper")), "key"), "shared-texts")
    level2 = ranked(written(shared.mapInArrow(_emit(blocks, length), _ROWS), "blocks"))
    again = shared.select("key", "text").join(_by_key(level2.where("deeper")), "key")
    level3 = ranked(written(again.mapInArrow(_emit(strings, length), _ROWS), "strings"))
    found = level1.unionAll(level2).unionAll(level3).where(F.col("flag") == _REPEATED)
    return found.select("key", "first", "last")


def spans(first: np.ndarray, last: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes that strings beginning in the given ranges cover."""
    order = np.argsort(first, kind="stable")
    a, b = first[order], np.maximum.accumulate(last[order] + length)
    new = np.append(True, a[1:] > b[:-1])
    return a[new], b[np.append(np.flatnonzero(new)[1:] - 1, len(a) - 1)]


def cut(docs: DataFrame, length: int, extra: str | StructType, fn) -> DataFrame:
    """``fn`` of each row's columns, text and marks (``__first``, ``__last``); ``docs`` has key (of its text) and text.

    A text that comes again is a repeat from end to end. Only one row of each such text goes through the levels, so
    copies, however many, cost no more than their own reading.
    """
    again = written(docs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    if again.count() <= SMALL:
        once, copies = docs.join(F.broadcast(again), "key", "left_anti"), docs.join(F.broadcast(again), "key", "left_semi")
    else:
        parted = written(docs.join(again.withColumn("__again", F.lit(True)), "key", "left"), "parted")
        once, copies = parted.where("__again is null").drop("__again"), parted.where("__again").drop("__again")
    long_enough = F.octet_length("text") >= length
    of_copies = written(copies.where(long_enough).select("key", "text").dropDuplicates(["key"]), "copies")
    found = repeats(once.select("key", "text").unionAll(of_copies), length)
    marks = found.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("m"))
    marked = once.join(marks, "key", "left").select(*docs.columns, F.col("m.first").alias("__first"), F.col("m.last").alias("__last"))
    whole = lambda c: F.when(long_enough, F.array(c.cast("int")))
    return marked.unionAll(copies.select(*docs.columns, whole(F.lit(0)), whole(F.octet_length("text") - length))).mapInArrow(fn, extra)


_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _digest(length: int):
    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text, first, last in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "__first", "__last")), strict=True):
                data = text.encode("utf-8", "surrogatepass")
                if first is None:
                    rows.append((doc_id, len(data), 0, 0, sha256(data).hexdigest()))
                    continue
                a, b = spans(np.array(first, "i8"), np.array(last, "i8"), length)
                kept = b"".join(data[x:y] for x, y in zip([0, *b.tolist()], [*a.tolist(), len(data)], strict=True))
                rows.append((doc_id, len(data), len(data) - len(kept), len(a), sha256(kept).hexdigest()))
            yield batch_of(_OUT, rows)

    return run


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """Per row of ``docs``: sizes, removed runs and the digest of the bytes that stay."""
    return cut(text_key(id_and_text(docs)), length, _OUT, _digest(length))


def _kept_text(length: int, words: int):
    def run(batches):
        for batch in batches:
            out = []
            for text, first, last in zip(*(batch.column(c).to_pylist() for c in ("text", "__first", "__last")), strict=True):
                if first is None:
                    out.append(text)
                    continue
                data = text.encode("utf-8", "surrogatepass")
                parts, at = [], 0
                for x, y in zip(*(s.tolist() for s in spans(np.array(first, "i8"), np.array(last, "i8"), length)), strict=True):
                    if words and len(data[x:y].split()) <= words:
                        continue
                    while x < y and data[x] & 0xC0 == 0x80:  # a character that is covered in part stays
                        x += 1
                    while y < len(data) and y > x and data[y] & 0xC0 == 0x80:
                        y -= 1
                    parts.append(data[at:x])
                    at = y
                out.append(b"".join([*parts, data[at:]]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([batch.column("rest"), pa.array(out, pa.string())], names=["rest", "text"])

    return run


def without_repeats(docs: DataFrame, length: int = LENGTH, words: int = 0) -> DataFrame:
    """The rows of ``docs`` without their repeated passages, whole characters kept; their other columns unchanged.

    With ``words``, only passages of more words than that go (a part of a word at a passage's end counts).
    """
    keyed = text_key(wrapped(docs).withColumn("text", F.coalesce("text", F.lit(""))))
    out = cut(keyed.drop("doc_id"), length, keyed.select("rest").schema.add("text", "string"), _kept_text(length, words))
    return unwrapped(out, docs.columns)
