import random
import re
from collections import Counter

import pytest

from tideline.llm import minhash, queries


def brute(rows, width, percent):
    """(doc_id, set size, component, kept) of rows (doc_id, text), by comparing all pairs that share a shingle."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        k = min(width, len(words))
        sets.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    above = [*range(len(rows))]

    def top(x):
        while above[x] != x:
            above[x] = x = above[above[x]]
        return x

    where = {}
    for i, s in enumerate(sets):
        for j, n in Counter(j for x in s for j in where.get(x, ())).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                above[top(i)] = top(j)
        for x in s:
            where.setdefault(x, []).append(i)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None and sets[i]:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least.get(top(i)) if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id is not None and doc_id == component))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


ODD = [(1, None), (2, ""), (3, " \n "), (4, "One two"), (9, "one TWO"), (5, "one"), (6, "É x"), (7, "é x"), (None, "one two"), (8, "x " * 30_000), (8, "x " * 30_000), (None, None)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_families(spark, monkeypatch, width, percent):
    """Copies of a few bases with more and more edits, in blocks so small that groups span many."""
    rng, rows = random.Random(3), [*ODD]
    for base in range(4):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60 + 40 * base)]
        for k in range(60):
            copy = [*words]
            for _ in range(rng.randrange(8)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10**6)}"
            rows.append((100 * base + k + 20, " ".join(copy)))
    df = spark.createDataFrame([(*r, 1, "clash", 2) for r in rows], "doc_id long, text string, node int, key string, size int").repartition(3)
    want = brute(rows, width, percent)
    assert found(minhash.near_duplicates(df, width, percent)) == want
    monkeypatch.setattr(minhash, "BLOCK", 7)
    assert found(minhash.near_duplicates(df, width, percent)) == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.near_duplicates(df).count() == 0
    assert found(minhash.near_duplicates(spark.createDataFrame(ODD[:2], "doc_id long, text string"))) == brute(ODD[:2], 5, 80)


def test_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    assert found(queries.op3_minhash(spark, "/root/testdata/sf0.01")) == brute(rows, 3, 85)


def test_words_of_a_special_form(spark):
    """Thue-Morse words, whose hashes are equal under any polynomial modulo a power of two."""
    rows = []
    for n, (a, b) in enumerate([("a", "b"), ("c", "x")]):
        for _ in range(11):
            a, b = a + b, b + a
        rows += [(10 * n + 1, a), (10 * n + 2, b), (10 * n + 3, f"{a} two three four"), (10 * n + 4, f"{b} two three four")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(minhash.near_duplicates(df, 3, 85)) == brute(rows, 3, 85)
    assert all(r.kept for r in minhash.near_duplicates(df, 3, 85).collect())
