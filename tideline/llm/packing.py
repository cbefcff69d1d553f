"""Hierarchical packing of tokenised documents into context windows of several lengths.

A document of n tokens goes to the smallest tier that holds it; what exceeds the longest tier fills whole windows of
its own. Each tier packs its documents best-fit; a long window's gap is filled from the shorter tiers' waiting pieces,
and only when nothing fits is a piece cut. A window is closed when it is exactly full, so closed windows have a power
of two of tokens and no padding. Windows of one tier are dealt to step groups of equal token totals, counted through
over all tasks: only a tier's last group is short.

First level: every task packs its own documents, with a bounded pool of waiting pieces. Second level: the open pieces
left at a task's end (less than the pool's bound) meet those of other tasks, again in bounded groups, and the last
window of such a group is the only one with padding. Null and empty texts are one end token; a repeated row is packed
as often as it comes. Very long texts fill windows of their own; ties keep the order of arrival; an empty table has no
pieces. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.common import batch_of, id_and_text, written
from tideline.llm.words import ids_of

TIERS = (256, 512, 1024, 2048)
#: Waiting pieces of each tier; tasks whose rests meet; tokens of a step group.
POOL, MEET, STEP_TOKENS = 64, 64, 16_384
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, nth long"
_RESTS = _PIECES + ", rest binary, task long"


class _Packer:
    """Packs pieces ``(length, doc_id, start, ids, doc_tokens)`` as they come; ids are little-endian 32-bit."""

    def __init__(self, first: int):
        self.pools: dict[int, list] = {t: [] for t in TIERS}
        self.next = first
        self.made, self.out, self.seen = dict.fromkeys(TIERS, 0), [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, top, at = len(ids) // 4, TIERS[-1], 0
        while total - at >= top:
            self.emit(top, [self.piece(doc_id, at, ids[4 * at : 4 * (at + top)], total)])
            at += top
        if at < total:
            self.wait(self.piece(doc_id, at, ids[4 * at :], total))

    def piece(self, doc_id, start, ids, total):
        self.seen += 1  # breaks ties in the order of arrival, so ids of documents are never compared
        return (len(ids) // 4, self.seen, doc_id, start, ids, total)

    def wait(self, piece) -> None:
        tier = next(t for t in TIERS if piece[0] <= t)
        pool = self.pools[tier]
        insort(pool, piece)
        if len(pool) > POOL and sum(p[0] for p in pool) >= tier:
            self.fill(tier)

    def fill(self, tier: int) -> None:
        """Closes one window of a tier: its longest piece first, then the longest that fits of this and shorter tiers."""
        window, room = [], tier
        pools = [self.pools[t] for t in reversed(TIERS) if t <= tier]
        while room:
            for pool in pools:
                if at := bisect_left(pool, (room + 1,)):
                    window.append(pool.pop(at - 1))
                    room -= window[-1][0]
                    break
            else:
                if not (pool := next((p for p in pools if p), None)):
                    break
                n, _, doc_id, start, ids, total = pool.pop(0)
                window.append(self.piece(doc_id, start, ids[: 4 * room], total))
                self.wait_quietly(self.piece(doc_id, start + room, ids[4 * room :], total))
                room = 0
        self.emit(tier, window)

    def wait_quietly(self, piece) -> None:
        insort(self.pools[next(t for t in TIERS if piece[0] <= t)], piece)

    def emit(self, tier: int, window: list) -> None:
        offset = 0
        for n, _, doc_id, start, ids, total in window:
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset, tier, self.made[tier]))
            offset += n
        self.next += 1
        self.made[tier] += 1

    def rests(self) -> list:
        """What is still waiting once no tier can close a full window from its own and shorter pieces."""
        for tier in reversed(TIERS):
            while sum(p[0] for t in TIERS if t <= tier for p in self.pools[t]) >= tier:
                self.fill(tier)
        return [p for t in TIERS for p in self.pools[t]]


def _local(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, stop, cache = TaskContext.get().partitionId(), np.array([end], "<u4").tobytes(), ids_of(path)
        packer = _Packer(task << 32)
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                packer.add(doc_id, cache.text(text) + stop)
                if len(packer.out) > 20_000:
                    yield batch_of(_RESTS, [(*x, None, None) for x in packer.out])
                    packer.out = []
        rests = packer.rests()
        rows = [(*x, None, None) for x in packer.out] + [(d, s, n, None, total, None, None, None, None, ids, task) for n, _, d, s, ids, total in rests]
        if rows:
            yield batch_of(_RESTS, rows)

    return run


def _together(key: tuple, table: pa.Table) -> pa.Table:
    """The rests of up to MEET tasks; only the last window, of less than the shortest tier, is padded."""
    packer = _Packer((1 << 62) + (key[0].as_py() << 32))
    rows = sorted(zip(*(table.column(c).to_pylist() for c in ("task", "length", "doc_id", "start", "rest", "doc_tokens")), strict=True), key=lambda r: (r[0], r[1], r[2] is None, r[2] or 0, r[3]))
    for _, _, doc_id, start, ids, total in rows:
        packer.wait(packer.piece(doc_id, start, ids, total))
    if packer.rests():
        packer.fill(TIERS[-1])
    return pa.Table.from_batches([batch_of(_PIECES, packer.out)])


def pack(docs: DataFrame, path: str, end: int = 1) -> DataFrame:
    """Pieces of all documents in windows of up to 2,048 tokens; ``path`` is the tokenizer's file, ``end`` the last id."""
    local = written(id_and_text(docs).mapInArrow(_local(path, end), _RESTS), "pack-local")
    done = local.where("rest is null").drop("rest", "task")
    rests = local.where("rest is not null").groupBy(F.floor(F.col("task") / MEET).alias("meeting")).applyInArrow(_together, _PIECES)
    return with_steps(done.unionAll(written(rests, "pack-rests")))


def with_steps(pieces: DataFrame) -> DataFrame:
    """Adds ``step_group`` from the windows' numbers within their task and tier (``nth``), which go."""
    lane = F.shiftright("sequence_id", 32).alias("lane")  # the task, or the meeting of tasks
    made = pieces.groupBy("tier", lane).agg((F.max("nth") + 1).alias("made"))
    before = F.sum("made").over(Window.partitionBy("tier").orderBy("lane")) - F.col("made")
    before = made.select(F.col("tier").alias("__tier"), F.col("lane").alias("__lane"), before.alias("__before"))  # a row for each task and tier
    step = F.floor((F.col("__before") + F.col("nth")) * F.col("tier") / STEP_TOKENS) * len(TIERS) + F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier")) - 1
    placed = pieces.join(before, (F.col("tier") == F.col("__tier")) & (F.shiftright("sequence_id", 32) == F.col("__lane")))
    return placed.withColumn("step_group", step.cast("long")).drop("nth", "__tier", "__lane", "__before")
