import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tideline.llm import queries, suffixes


def brute(rows, length):
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(hash(d[p : p + length]) for _, d in data for p in range(len(d) - length + 1))
    out = []
    for i, d in data:
        hit = np.zeros(len(d) + 1, int)
        for p in range(len(d) - length + 1):
            if seen[hash(d[p : p + length])] > 1:
                hit[p] += 1
                hit[p + length if p + length <= len(d) else len(d)] -= 1
        gone = np.cumsum(hit[:-1]) > 0
        starts = int((gone & ~np.append(False, gone[:-1])).sum()) if len(d) else 0
        kept = bytes(np.frombuffer(d, "u1")[~gone]) if d else b""
        out.append((i, len(d), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


def make(seed, n=60):
    """Texts with shared passages, edits, periods and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 90))) for _ in range(6)]
    rows = [(1, None), (None, ""), (2, "short"), (3, "ab" * 700), (4, "x" * 900), (5, passages[0]), (5, passages[0]), (6, passages[0])]
    for i in range(n):
        text = " ".join(rng.choice(passages) if rng.random() < 0.3 else word() for _ in range(rng.randrange(1, 60)))
        if rng.random() < 0.2:
            text = list(text)
            text[rng.randrange(len(text))] = "#"
            text = "".join(text)
        rows.append((i + 10, text))
        if rng.random() < 0.1:
            rows.append((i + 1000, text))
    return rows


@pytest.mark.parametrize(("seed", "length"), [(1, 400), (3, 60)])
def test_random(spark, monkeypatch, seed, length):
    rows = make(seed)
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, first string, flag int").repartition(3)
    want = brute(rows, length)
    assert found(suffixes.digests(df, length)) == want
    monkeypatch.setattr(suffixes, "BUCKET", 300)  # ties across many boundaries
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    assert found(suffixes.digests(df, length)) == want


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(queries.op10_suffixes(spark, "/root/testdata/sf0.01")) == brute(rows, 400)


def test_texts(spark):
    rows = make(9, 30)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int")
    out = suffixes.without_repeats(df, 100)
    assert out.columns == df.columns
    kept = {r.row: r.text for r in out.collect()}
    sizes = {(i, n): n - gone for i, n, gone, _, _ in brute(rows, 100)}
    for k, (i, t) in enumerate(rows):
        n = len((t or "").encode())
        assert sizes[i, n] <= len(kept[k].encode()) <= sizes[i, n] + 2 * 20
    assert suffixes.digests(df.limit(0)).count() == 0 and suffixes.without_repeats(df.limit(0)).count() == 0


def test_multikey_order():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, 4, 500) for _ in range(3)]
    rows = np.stack(columns, 1)
    assert (rows[suffixes.multikey_order(columns)] == np.array(sorted(map(tuple, rows.tolist())))).all()
    assert (suffixes.multikey_order([np.arange(5)[::-1]]) == [4, 3, 2, 1, 0]).all()


def test_equal_rows(spark):
    """Many equal rows cost no more than one in the search, and all of them go; strings of a form that fools polynomials."""
    rng = random.Random(2)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(300))
    a, b = "c", "x"
    for _ in range(11):
        a, b = a + b, b + a
    rows = [(k % 50, text) for k in range(2000)] + [(5000, f"{text} more"), (5001, "some words and " + text[:700]), (5002, a), (5003, b + "c"), (5004, "short"), (5004, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(suffixes.digests(df)) == brute(rows, 400)


def test_many_copies(spark, monkeypatch):
    """Beyond the bound of a broadcast, repeated texts are told apart by a shuffle."""
    rows = make(11, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "SMALL", 0)
    assert found(suffixes.digests(df, 100)) == brute(rows, 100)


def test_small_buckets_share_files(spark, monkeypatch):
    """Many buckets of few rows: tasks write a file for several of them, and what meets at their ends is still found."""
    rows = make(5)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    tables, write = [], suffixes.written
    monkeypatch.setattr(suffixes, "written", lambda df, name: tables.append((name, write(df, name))) or tables[-1][1])
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    try:
        assert found(suffixes.digests(df, 60)) == brute(rows, 60)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert [len(t.inputFiles()) <= 2 * spark.sparkContext.defaultParallelism for name, t in tables if name == "ranked"] == [True] * 3
