import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe, packing
from tideline.llm.words import Ids, chunks

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", None, " \n\t", "Hello, WORLD! it's 1234 we'll see", "a<|endoftext|>b <|startoftext|>\x1cx\x1dy", "Ünïcödé é İstanbul ΣΑΣ  x y ́z", "日本語 テキスト 🙂🙂 ẞ", "the " * 5000, "x" * 4000, "same text", "same text", "a\x00b\x85c", "…—“q” <|endoftext|", "ﬁ ½ ²３"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "clash", 5, "k") for i, t in enumerate(TEXTS)] + [(9, "same text", "again", 0, "k")]
    return spark.createDataFrame(rows, "doc_id long, text string, block string, bucket int, key string").repartition(3)


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def test_every_character_alone(tok):
    ids, bad = Ids(PATH), []
    for c in [*range(1, 0xD800), *range(0xE000, 0x11000), *range(0x1F300, 0x1F700)]:
        text = f"aB{chr(c)}3.{chr(c)}{chr(c)} Z{chr(c)}e"
        if ids.text(text) != np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes():
            bad.append(c)
    assert not bad


def test_encode_decode(docs, tok, monkeypatch):
    out = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(docs, PATH, digests=True).collect())
    want = []
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id is None, r.doc_id or 0, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert out == sorted(want)


def test_small_blocks(spark, docs, monkeypatch):
    whole = sorted(bpe.encode_decode(docs, PATH, digests=True).collect(), key=str)
    monkeypatch.setattr(bpe, "BLOCK_CHARS", 10)
    assert sorted(bpe.encode_decode(docs.coalesce(1), PATH, digests=True, lists=3).collect(), key=str) == whole
    assert bpe.encode_decode(docs.limit(0), PATH).count() == 0
    full = {r.doc_id: (len(r.ids) // 4, r.decoded) for r in bpe.encode_decode(docs, PATH).collect()}
    assert full[None][0] > 5 and full[1] == (0, "") and full[9] == (2, "same</w> text</w>")


def test_buckets_follow_the_table(spark, docs):
    """More buckets than a byte can number give the same ids, and their number grows with the root of the partitions."""
    assert bpe.buckets(spark.range(9).repartition(4)) == bpe.LISTS
    assert bpe.buckets(spark.createDataFrame(spark.sparkContext.parallelize([(1,)], 400), "doc_id long")) == 160
    few, many = (sorted(bpe.encode_decode(docs, PATH, digests=True, lists=n).collect(), key=str) for n in (1, 300))
    assert few == many


def test_cache_is_bounded(tok):
    small = Ids(PATH)
    small.limit = small.parts.limit = 3
    for text in ("a b c", "c d e f g h", "a"):
        assert small.text(text) == np.array(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(small) <= 3


def check_packing(rows, docs, tok):
    """Every id in one piece, gapless windows, and padding in the last window of a meeting alone."""
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(tok.encode(r.text or "", add_special_tokens=False).ids + [1])
    windows, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
    padding = 0
    for parts in windows.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert pieces.keys() == texts.keys()
    for doc_id, many in texts.items():
        if len({tuple(x) for x in many}) == 1:
            ids, n = many[0], len(many)
            seen = np.zeros(len(ids), int)
            for r in pieces[doc_id]:
                assert r.doc_tokens == len(ids)
                assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
                seen[r.start : r.start + r.length] += 1
            assert (seen == n).all()
    return padding


def test_packing(spark, docs, tok):
    assert check_packing(packing.pack(docs, PATH).collect(), docs, tok) <= 2048
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_packing_documents(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(5)
    rows = packing.pack(docs, PATH).collect()
    assert check_packing(rows, docs, tok) <= 2048
    steps = defaultdict(int)
    for r in rows:
        steps[r.step_group] += r.length
    assert max(steps.values()) == packing.STEP_TOKENS
    assert sum(n < packing.STEP_TOKENS for n in steps.values()) <= len(packing.TIERS)  # the last group of each tier


def test_odd_white_space():
    assert chunks("a\x1cb c\n") == ["a\x1cb", "c"]


def test_frequent_words_stay_cached():
    """What is asked for again and again is made once, and the cache stays within its limit."""
    from tideline.llm import words

    made = []

    class Counted(words._Bounded):
        limit = 8

        def make(self, x):
            made.append(x)
            return x.encode()

    cache = Counted("path")
    for k in range(200):
        assert cache["hot"] == b"hot"
        assert cache[f"rare{k}"] == f"rare{k}".encode()
        assert len(cache) + len(cache.old) <= 8
    assert made.count("hot") == 1
    assert len(made) == 201
