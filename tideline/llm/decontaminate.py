"""Benchmark decontamination: Wu-Manber search for every window of every benchmark item in every document.

1. The windows of the benchmark (ten consecutive words; an item of fewer words is one window) are found once.
2. Shift table: for each block of three words (of all, in shorter windows) that a window holds, how far a search may move
   on when it sees the block's hash; a hash that no window holds allows the longest move. It is a table of 2 ** 22 bytes
   at most, whatever the benchmark's size, and is broadcast beside a bit table (2 ** 27 bits at most) of whole windows.
3. A document's positions are searched in lanes that each move on by the table: most positions are never looked at.
   Where the move is 0, the bits tell whether a window may end there; if so, its words are written down with its place.
4. Candidates meet the windows in the bucket of their suffix's hash, and are compared as text. So hashes decide nothing.

The tables are bounded, so neither the number of windows nor that of documents is limited: beyond about a million
windows more positions are looked at and more candidates are compared.

* Null and empty texts have no words, are not hit and contaminate nothing. Very long texts are searched whole, and their
  words are hashed piece by piece. A table without rows has no rows in the result, or hits nothing.
* Repeated documents have a row each. Items that repeat, or share an id, count once by id; the windows of an item without
  an id are hit like others, but it isn't in ``n_items`` or ``items_sha256``.
* Overlapping windows count each word once. Other columns are left out.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import batch_from, batch_of, sliced, written
from tideline.llm.hashing import mix

#: Words of a window and of a block; bytes that are hashed at once; positions of a lane.
WIDTH, BLOCK, PIECE, LANE = 10, 3, 1 << 20, 128
#: Powers of two: the largest shift table and bit table.
SHIFTS, BITS = 22, 27
_BREAK = re.compile(b"[^0-9a-z\x80-\xff]").search
_IN_WORD = np.array([48 <= b <= 57 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_FACTOR, _NEXT = np.uint64(0x9E3779B97F4A7C55), np.uint64(0xD1342543DE82EF95)


def _hashed(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, "u1")
    inside = np.concatenate([[False], _IN_WORD[raw], [False]])
    starts, ends = np.nonzero(inside[1:] & ~inside[:-1])[0], np.nonzero(inside[:-1] & ~inside[1:])[0]
    if not len(starts):
        return starts, ends, np.zeros(0, "u8")
    size = ends - starts
    first = np.cumsum(size) - size
    powers = np.cumprod(np.full(size.max(), _FACTOR, "u8"))
    values = (raw[inside[1:-1]].astype("u8") + np.uint64(1)) * powers[np.arange(first[-1] + size[-1]) - np.repeat(first, size)]
    return starts, ends, mix(np.add.reduceat(values, first) ^ size.astype("u8") * _NEXT)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text in lower case start and end, and their hashes; long texts in pieces between words."""
    parts, at = [], 0
    while at < len(data) or not parts:
        stop = _BREAK(data, min(at + PIECE, len(data)))
        end = stop.start() if stop else len(data)
        starts, ends, found = _hashed(data[at:end])
        parts.append((starts + at, ends + at, found))
        at = end + 1
    return tuple(map(np.concatenate, zip(*parts, strict=True)))


def _runs(hashes: np.ndarray, ends: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` words up to each place of ``ends``."""
    out = np.full(len(ends), width, "u8")
    for k in range(width - 1, -1, -1):
        out = out * _NEXT + hashes[ends - k]
    return mix(out)


def _slots(found: np.ndarray, power: int, probe: int) -> np.ndarray:
    return (found >> np.uint64(1 + 29 * probe) & np.uint64((1 << power) - 1)).astype("i8")


def _block(width: int) -> int:
    return min(BLOCK, width)


def _batches(batches, column: str = "text"):
    """Texts of about a piece at a time: joined with a byte between them, with the place of each."""
    for batch in sliced(batches, 1000):
        texts = [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in batch.column(column).to_pylist()]  # of bytes: A-Z alone
        at = 0
        while at < len(texts):
            to, size = at, 0
            while to < len(texts) and (to == at or size + len(texts[to]) < PIECE):
                size, to = size + len(texts[to]) + 1, to + 1
            places = np.cumsum([0, *(len(t) + 1 for t in texts[at:to])])
            yield batch.slice(at, to - at), b"\0".join(texts[at:to]), places
            at = to


_WINDOWS = "width int, window binary, suffix long, item_id long"


def _windows(batches):
    """The distinct windows of each item."""
    for batch, data, places in _batches(batches):
        starts, ends, found = words(data)
        owner = np.searchsorted(places, starts, "right") - 1
        rows = []
        for k, item_id in enumerate(batch.column("item_id").to_pylist()):
            a, b = np.searchsorted(owner, (k, k + 1)).tolist()
            width = min(WIDTH, b - a)
            if width:
                last = np.arange(a + width - 1, b)
                suffix = _runs(found, last, _block(width)).view("i8").tolist()
                texts = [data[starts[i] : ends[i]] for i in range(a, b)]
                rows += {(width, b" ".join(texts[i : i + width]), s, item_id) for i, s in enumerate(suffix)}
        yield batch_of(_WINDOWS, rows)


def _entries(shifts: int, bits: int):
    """Rows of both tables: slot and move, or (from -1 down) word of bits and the bit."""

    def run(batches):
        for batch in sliced(batches, 1000):
            slots, values = [], []
            for width, window in zip(batch.column("width").to_pylist(), batch.column("window").to_pylist(), strict=True):
                found = words(window)[2]
                block = _block(width)
                ends = np.arange(block - 1, width)
                slots += _slots(_runs(found, ends, block) + np.uint64(width), shifts, 0).tolist()
                values += (width - 1 - ends).tolist()
                whole = _runs(found, np.array([width - 1]), width)
                for probe in (0, 1):
                    bit = int(_slots(whole, bits, probe)[0])
                    slots.append(-1 - (bit >> 5))
                    values.append(1 << (bit & 31))
            yield batch_from("slot long, value long", slot=slots, value=values)

    return run


class Tables:
    """The widths of windows, moves by block hash and bits of whole windows; all of a bounded size."""

    def __init__(self, windows: DataFrame):
        sizes = windows.groupBy("width").agg(F.count("*").alias("n")).collect()
        self.widths = sorted(r.width for r in sizes)
        n = max(1, sum(r.n for r in sizes))
        self.shifts, self.bits = min(SHIFTS, max(12, (16 * n).bit_length())), min(BITS, max(12, (32 * n).bit_length()))
        rows = windows.mapInArrow(_entries(self.shifts, self.bits), "slot long, value long")
        least = rows.where("slot >= 0").groupBy("slot").agg(F.min("value").alias("value")).toPandas()
        bits = rows.where("slot < 0").groupBy("slot").agg(F.bit_or("value").alias("value")).toPandas()
        self.move, self.word = np.full(1 << self.shifts, 255, "u1"), np.zeros(1 << self.bits - 5, "u4")
        self.move[least.slot.to_numpy("i8")] = least.value.to_numpy("i8")
        self.word[-1 - bits.slot.to_numpy("i8")] = bits.value.to_numpy("i8")

    def ends(self, hashes: np.ndarray, width: int) -> np.ndarray:
        """Places at which a window of ``width`` words may end, in order."""
        block = _block(width)
        longest, out = width - block + 1, []
        if len(hashes) < width:
            return np.zeros(0, "i8")
        at = np.arange(width - 1, len(hashes), LANE)
        until = np.minimum(at + LANE, len(hashes))
        while len(at):
            move = np.minimum(self.move[_slots(_runs(hashes, at, block) + np.uint64(width), self.shifts, 0)], longest)
            here = at[move == 0]
            if len(here):
                whole = _runs(hashes, here, width)
                for probe in (0, 1):
                    bit = _slots(whole, self.bits, probe)
                    some = (self.word[bit >> 5] >> (bit & 31).astype("u4") & 1).astype(bool)
                    here, whole = here[some], whole[some]
                out.append(here)
            at = at + np.maximum(move, 1)
            some = at < until
            at, until = at[some], until[some]
        return np.sort(np.concatenate(out)) if out else np.zeros(0, "i8")


_FOUND = "row long, doc_id long, n_words long, width int, window binary, suffix long, starts array<int>"


def _search(tables):
    """A row for each document, and one for each of its candidates with the places where it starts."""

    def run(batches):
        t = tables.value
        for batch, data, places in _batches(batches):
            starts, ends, found = words(data)
            owner = np.searchsorted(places, starts, "right") - 1
            first = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            ids = list(zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), np.diff(first).tolist(), strict=True))
            rows = [(*own, None, None, None, None) for own in ids]
            for width in t.widths:
                last = t.ends(found, width)
                last = last[owner[last - width + 1] == owner[last]]
                suffix = _runs(found, last, _block(width)).view("i8").tolist()
                places_of = defaultdict(list)
                for e, s in zip(last.tolist(), suffix, strict=True):
                    text = b" ".join([data[a:b] for a, b in zip(starts[e - width + 1 : e + 1].tolist(), ends[e - width + 1 : e + 1].tolist(), strict=True)])
                    places_of[int(owner[e]), text, s].append(e - width + 1 - int(first[owner[e]]))
                rows += [(*ids[k], width, text, s, at) for (k, text, s), at in places_of.items()]
            yield batch_of(_FOUND, rows)

    return run


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` of every row of ``docs``; see the module."""
    spark: SparkSession = docs.sparkSession
    of_items = written(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_windows, _WINDOWS).distinct(), "windows")
    windows = written(of_items.select("width", "window", "suffix").distinct(), "distinct")
    tables = spark.sparkContext.broadcast(Tables(windows))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = written(rows.mapInArrow(_search(tables), _FOUND), "found")  # written once, so its row numbers stay

    key = ["suffix", "width", "window"]
    true = written(found.where("window is not null").drop("doc_id", "n_words").join(windows, key, "left_semi"), "hits")
    spans = F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("a"), (s + F.col("width")).alias("b")))))
    begin = F.struct(F.lit(0).alias("to"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["to"], s["b"]).alias("to"), (acc["n"] + F.greatest(F.lit(0), s["b"] - F.greatest(acc["to"], s["a"]))).alias("n"))
    covered = true.groupBy("row").agg(F.sort_array(spans).alias("spans")).select("row", F.aggregate("spans", begin, step)["n"].alias("n_hit"))
    pairs = true.select("row", *key).join(of_items.where("item_id is not null"), key).select("row", F.col("item_id").cast("string").alias("item")).distinct()
    items = pairs.groupBy("row").agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list("item")), ",").alias("items"))
    out = found.where("window is null").select("row", "doc_id", "n_words").join(covered.join(items, "row", "left"), "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


SQL = r"""
WITH split AS (
  SELECT 'd' AS kind, rid AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT *, row_number() OVER () AS rid FROM documents)
  UNION ALL
  SELECT 'b', item_id, NULL, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
windows AS MATERIALIZED (
  SELECT DISTINCT id AS item_id, least(10, len(w)) AS width, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS t
  FROM split, generate_series(1, len(w) - least(10, len(w)) + 1) g(i) WHERE kind = 'b' AND len(w) > 0),
widths AS (SELECT DISTINCT width FROM windows),
places AS (
  SELECT id, width, i, array_to_string(w[i : i + width - 1], ' ') AS t
  FROM split, widths, generate_series(1, len(w) - width + 1) g(i) WHERE kind = 'd'),
hit AS MATERIALIZED (SELECT p.id, p.i, p.width, b.item_id FROM places p JOIN windows b ON b.width = p.width AND b.t = p.t),
covered AS (SELECT id, count(*) AS n_hit FROM (SELECT DISTINCT id, i + k AS j FROM hit, generate_series(0, width - 1) g(k)) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items FROM (SELECT DISTINCT id, CAST(item_id AS VARCHAR) AS s FROM hit WHERE item_id IS NOT NULL) GROUP BY id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN covered USING (id) LEFT JOIN items USING (id) WHERE kind = 'd'
"""
