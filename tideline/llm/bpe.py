"""BPE encoding and decoding over a distinct-word table.

1. Split: documents are cut into white-space words, and a block of documents numbers its own distinct words.
2. Encode: the distinct words of all blocks meet by hash; each distinct word is encoded once for the whole corpus.
3. Join back: the answers return to their block, and a document's ids are put in place by word position.
4. Decode: a word's ids are joined to the tokenizer's id-to-piece table (bounded by its vocabulary).

What is shuffled is each block's distinct words and the word numbers of the documents, never one row for each token.
A block is named by its content and split twice, once for its words and once for its numbers, so nothing is stored in
between; ``docs`` must give the same rows in the same partitions each time, as a table does. If it doesn't, a block's
answers are missing and the task fails: no wrong ids are returned.
Null and empty texts have no ids and decode to the empty text. Repeated rows give repeated rows; a very long text is one
row of its block and is encoded whole. Empty tables give no rows. Of equal words in several blocks each block gets the
same answer, so ties don't matter. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.common import batch_of, id_and_text
from tideline.llm.words import chunks, ids_of, tokenizer

#: Characters of documents that share a word numbering, documents of one stored row, the fewest buckets of distinct words.
BLOCK_CHARS, TOGETHER, LISTS = 32_000_000, 100, 64
_SPLIT = "block long, bucket int, doc_ids array<long>, sizes array<int>, data binary"
_FULL = "doc_id long, ids binary, decoded string"
_DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class _Numbers(dict):
    """Numbers words in the order in which they first come."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _pack(x: np.ndarray) -> bytes:
    """Seven bits a byte, the low ones first, and compressed; for numbers below 2^28."""
    x = x.astype("u4")
    parts = np.empty((len(x), 4), "u1")
    for k in range(4):
        parts[:, k] = x >> 7 * k & 127 | np.where(x >> 7 * k + 7 > 0, 128, 0)
    keep = np.ones((len(x), 4), bool)
    for k in range(1, 4):
        keep[:, k] = x >> 7 * k > 0
    return zlib.compress(parts[keep].tobytes(), 6)


def _unpack(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data), "u1")
    last = np.flatnonzero(flat < 128)
    starts = np.concatenate([[0], last[:-1] + 1])[: len(last)]
    out = np.zeros(len(last), "u4")
    for k in range(4):
        at = starts + k
        inside = at <= last
        out[inside] |= (flat[at[inside]] & 127).astype("u4") << 7 * k
    return out


class _Block:
    """Documents whose words share one numbering, the most frequent word first."""

    def __init__(self):
        self.words, self.size, self.docs, self.codes = _Numbers(), 0, [], []

    def add(self, doc_id: int | None, text: str) -> None:
        self.codes.append(np.array([*map(self.words.__getitem__, chunks(text))], "u4"))
        self.docs.append(doc_id)
        self.size += len(text)

    def rows(self, lists: int, words: bool) -> Iterator[pa.RecordBatch]:
        """The words of each bucket, or else the documents' word numbers (bucket -1) and each number's bucket (-2)."""
        order = np.argsort(-np.bincount(np.concatenate(self.codes), minlength=len(self.words)), kind="stable")
        ranked = [*self.words]
        ranked = [ranked[i].encode("utf-8", "surrogatepass") for i in order.tolist()]
        name = int.from_bytes(blake2b(b" ".join(ranked), digest_size=8).digest(), "little", signed=True)
        of = [zlib.crc32(w) % lists for w in ranked]
        if words:
            by: list[list[bytes]] = [[] for _ in range(lists)]
            for bucket, word in zip(of, ranked, strict=True):
                by[bucket].append(word)
            for bucket, some in enumerate(by):
                if some:
                    yield batch_of(_SPLIT, [(name, bucket, None, None, zlib.compress(b" ".join(some), 6))])
            return
        yield batch_of(_SPLIT, [(name, -2, None, None, zlib.compress(np.array(of, "<u2").tobytes(), 1))])
        rank = np.empty(len(order), "u4")
        rank[order] = np.arange(len(order), dtype="u4")
        for at in range(0, len(self.docs), TOGETHER):
            codes = self.codes[at : at + TOGETHER]
            yield batch_of(_SPLIT, [(name, -1, self.docs[at : at + TOGETHER], [*map(len, codes)], _pack(rank[np.concatenate(codes)]))])


def _split(lists: int, words: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                block.add(doc_id, text)
                if block.size >= BLOCK_CHARS:
                    yield from block.rows(lists, words)
                    block = _Block()
        if block.docs:
            yield from block.rows(lists, words)

    return run


def _encode(path: str):
    """A bucket's word lists meet in one task, which encodes each distinct word once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[str, bytes] = {}
        for batch in batches:
            for block, bucket, data in zip(*(batch.column(c).to_pylist() for c in ("block", "bucket", "data")), strict=True):
                words = zlib.decompress(data).decode("utf-8", "surrogatepass").split(" ")
                if new := [w for w in words if w not in table]:
                    table.update(zip(new, map(ids_of(path).make, new), strict=True))
                found = [table[w] for w in words]
                sizes = np.fromiter(map(len, found), "u4", len(found)) // 4
                yield batch_of(_SPLIT, [(block, bucket, None, [len(found)], _pack(np.concatenate([sizes, np.frombuffer(b"".join(found), "<u4")])))])

    return run


def _put_back(path: str, digests: bool):
    """One block: its words' ids in the order of their numbers, then each document's ids by position."""

    def run(table: pa.Table) -> pa.Table:
        bucket, data, sizes, docs = np.asarray(table.column("bucket")), table.column("data"), table.column("sizes"), table.column("doc_ids")
        of = np.frombuffer(zlib.decompress(data[int(np.flatnonzero(bucket == -2)[0])].as_py()), "<u2")
        ids = [b""] * len(of)
        order, place = np.argsort(of, kind="stable").tolist(), 0
        buckets, answers = np.unique(bucket, return_index=True)  # blocks of equal words have equal answers
        answers = answers[buckets >= 0]
        for at in answers.tolist():
            n, x = sizes[at].as_py()[0], _unpack(data[at].as_py())
            flat, a = x[n:].astype("<u4").tobytes(), 0
            for size in (4 * x[:n]).tolist():
                ids[order[place]] = flat[a : a + size]
                place, a = place + 1, a + size
        if place < len(order):
            raise ValueError("documents changed while they were read: a block's words have no ids")
        pieces = [" " + tokenizer(path).id_to_token(i) for i in range(tokenizer(path).get_vocab_size())]
        spelt = ["".join([pieces[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in ids]
        out = []
        for at in np.flatnonzero(bucket == -1).tolist():
            codes, a = _unpack(data[at].as_py()).tolist(), 0
            for doc_id, n in zip(docs[at].as_py(), sizes[at].as_py(), strict=True):
                own, a = codes[a : a + n], a + n
                whole, text = b"".join([ids[c] for c in own]), "".join([spelt[c] for c in own])[1:]
                if digests:
                    out.append((doc_id, len(whole) // 4, sha256(whole).hexdigest(), sha256(text.encode("utf-8", "surrogatepass")).hexdigest()))
                else:
                    out.append((doc_id, whole, text))
        return pa.Table.from_batches([batch_of(_DIGESTS if digests else _FULL, out)])

    return run


def buckets(docs: DataFrame) -> int:
    """Buckets for the distinct words of ``docs``: with the square root of its partitions, as new words become rarer.

    So neither a bucket's words nor the rows that each block sends to buckets grow in proportion to the table.
    """
    return min(1 << 16, max(LISTS, math.ceil(8 * math.sqrt(docs.rdd.getNumPartitions()))))


def encode_decode(docs: DataFrame, path: str, digests: bool = False, lists: int | None = None) -> DataFrame:
    """``doc_id, ids, decoded`` of every row of ``docs``: ids as little-endian unsigned 32-bit integers.

    With ``digests``, their number and SHA-256 instead, computed where the block is. ``lists`` (up to 65,536; else that
    of ``buckets``) is the number of buckets over which the distinct words are dealt, by as many tasks.
    """
    texts = id_and_text(docs)
    lists = lists or buckets(texts)
    answers = texts.mapInArrow(_split(lists, True), _SPLIT).repartition(lists, "bucket").mapInArrow(_encode(path), _SPLIT)
    return texts.mapInArrow(_split(lists, False), _SPLIT).unionAll(answers).groupBy("block").applyInArrow(_put_back(path, digests), _DIGESTS if digests else _FULL)
