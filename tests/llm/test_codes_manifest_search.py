"""Vector codes, the Merkle manifest and the benchmark search against plain versions on odd rows."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest

from tideline.llm import codes, decontaminate, manifest, queries


def found(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["op11_codes", "op12_manifest", "op13_decontamination"])
def test_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    df, want = queries.queries()[name](spark, sf), con.sql(queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert found(df.select(*want.columns)) == sorted(want.fetchall(), key=str)


# vector codes


def plain_codes(rows, rounds=4):
    kept = [(i, [math.floor(1024 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in kept), default=0) // 4))
    kept = sorted(((i, [max(-(1 << 26), min(1 << 26, x)) for x in v] + [0] * (4 * width - len(v)), label) for i, v, label in kept), key=lambda r: (r[0] is None, r[0] or 0))
    parts = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(4)]
    books = [[parts(v)[p] for _, v, _ in kept[:256]] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    code = lambda v: [min((far(x, e), k) for k, e in enumerate(books[p])) for p, x in enumerate(parts(v))]
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, k) in enumerate(code(v)):
                members[p, k].append(parts(v)[p])
        for (p, k), own in members.items():
            books[p][k] = tuple(sum(c) // len(own) for c in zip(*own, strict=True))
    digest = sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    coded = [(i, code(v), label) for i, v, label in kept]
    by_label = Counter()
    for _, c, label in coded:
        by_label[label] += sum(d for d, _ in c)
    return sorted(((i, bytes(k for _, k in c).hex(), sum(d for d, _ in c), by_label[label], digest) for i, c, label in coded), key=str)


CODES = "vec_id long, embedding array<float>, label int, code string, x int"


def test_codes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, np.float32(rng.normal(size=8) + i % 7).tolist(), [None, 1, 2][i % 3]) for i in range(400)]
    rows += [(500, None, 1), (501, [1.0, None, *[0.0] * 6], 1), (502, [math.inf, *[0.0] * 7], 1), (503, [math.nan, *[0.0] * 7], 2)]
    rows += [rows[0], rows[0], (None, [0.5] * 8, None), (504, [1e30, *[-3e30] * 7], 9), (505, [1.0, 2.0], 9), (506, [], 9)]
    df = spark.createDataFrame([(*r, "clash", 0) for r in rows], CODES).repartition(5)
    assert found(codes.encode(df)) == plain_codes(rows)


def test_codes_of_few_and_none(spark):
    rows = [(3, [0.1, 0.2, 0.3, 0.4], 1), (1, [0.5, 0.5, 0.5, 0.5], 1), (2, [0.5, 0.5, 0.5, 0.5], None)]
    assert found(codes.encode(spark.createDataFrame([(*r, "", 0) for r in rows], CODES))) == plain_codes(rows)
    assert found(codes.encode(spark.createDataFrame([], CODES))) == []
    assert found(codes.encode(spark.createDataFrame([(1, None, 1, "", 0)], CODES))) == []


def test_codes_move_only_changes(spark):
    """The running sums after three rounds are those of all vectors under their last assignment."""
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).tolist(), 0, "", 0) for i in range(900)]
    frame = spark.createDataFrame(rows, CODES)
    whole = codes.written(frame.select("vec_id", "label", "embedding").mapInArrow(codes._whole(4), "vec_id long, label int, x binary, code binary"), "t")
    first = [bytes(r.x) for r in whole.orderBy("vec_id").limit(256).collect()]
    after, books = codes.fit(whole, first, 1, 3)
    last = after.collect()
    x, code = np.array([np.frombuffer(r.x, "<i4") for r in last]), np.array([list(r.code) for r in last])
    assert any(bytes(r.before) != bytes(r.code) for r in last)
    for p in range(4):
        for k in set(code[:, p]):
            own = x[code[:, p] == k, p]
            assert books[p, k, 0] == own.sum() // len(own)


def test_nearest_of_large_numbers():
    x, book = np.array([[1 << 26, -(1 << 26)]]), np.array([[(1 << 26) - 1, -(1 << 26)], [1 << 26, 1 - (1 << 26)], [0, 0]])
    assert [a.tolist() for a in codes.nearest(x, book)] == [[0], [1]]


# Merkle manifest


def plain_manifest(rows):
    h = lambda *t: sha256("".join(t).encode()).hexdigest()
    field = lambda x: "-" if x is None else f"{len(str(x).encode())}:{x}"
    leaf = lambda i, s, g, n, t: h(*map(field, (i, s, g, n, t)))

    def grown(level):
        levels = [level]
        while len(levels[-1]) > 1:
            levels.append([h(*levels[-1][k : k + 2]) for k in range(0, len(levels[-1]), 2)])
        return levels

    def way(levels, k):
        out = []
        for level in levels[:-1]:
            out.append((k & 1, level[k ^ 1] if k ^ 1 < len(level) else None))
            k //= 2
        return out

    order = lambda x: (x is not None, x.encode() if isinstance(x, str) else x or 0)
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append(r)
    trees = {}
    for g in sorted(groups, key=order):
        groups[g].sort(key=lambda r: (order(r[0]), leaf(*r)))
        trees[g] = grown([leaf(*r) for r in groups[g]])
    top = grown([t[-1][0] for t in trees.values()]) if trees else []
    out = []
    for k, (g, levels) in enumerate(trees.items()):
        for j, (i, s, _, n, t) in enumerate(groups[g]):
            steps = way(levels, j) + way(top, k)
            own = leaf(i, s, g, n, t)
            wrong = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n is not None
            a = leaf(i, s, g, n + 1, t) if wrong else own
            for side, b in steps:
                a = h(a) if b is None else h(b, a) if side else h(a, b)
            out.append((i, own, levels[-1][0], top[-1][0], h(*(b for _, b in steps if b)), a, a == top[-1][0]))
    return sorted(out, key=str)


DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, g int, n int"


def make_docs(seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice([rng.randrange(-50, 3000), rng.randrange(1 << 62), None] if rng.random() < 0.1 else [len_ for len_ in range(n)]), rng.choice(["a", None, ""]), rng.choice(["en", "en", "en", "de", "é", "", None, "enx"]), rng.choice([None, 1, (1 << 63) - 1]), rng.choice(["", None, "te xt é", "y" * 5000])) for _ in range(n)]
    return rows + rows[:1] * 9 + [(-(1 << 63), "s", "en", 0, "x"), ((1 << 63) - 1, "s", "en", 0, "x")]


@pytest.mark.parametrize(("n", "bucket"), [(0, 4096), (37, 1), (3000, 50)])
def test_manifest(spark, monkeypatch, n, bucket):
    monkeypatch.setattr(manifest, "BUCKET", bucket)
    monkeypatch.setattr(manifest, "COPIES", 4)
    rows = make_docs(n, n) if n else []
    df = spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], DOCS).repartition(3)
    assert found(manifest.manifest(df)) == plain_manifest(rows)


def test_manifest_of_single_leaves(spark):
    for rows in ([(1, "s", "en", 3, "abc")], [(1, "s", "en", 3, "abc"), (1, "s", None, 3, "abc"), (8, "s", "de", 3, "")]):
        assert found(manifest.manifest(spark.createDataFrame([(*r, "", 0, 0) for r in rows], DOCS))) == plain_manifest(rows)


def test_ranks(spark):
    """Clustered keys of several lengths, one group most of the rows."""
    rng = random.Random(3)
    keys = {("a" if rng.random() < 0.8 else "b", "f" * 5 + f"{rng.choice([0, 1 << 40]) + rng.randrange(3000):x}") for _ in range(2500)}
    rows = [(g, k, rng.randrange(1, 4)) for g, k in keys]
    out = {(r.g, r.key): (r.first, r.total) for r in manifest.ranked(spark.createDataFrame(rows, "g string, key string, n long"), ["key"]).collect()}
    for g in "ab":
        at, total = 0, sum(n for h, _, n in rows if h == g)
        for _, k, n in sorted(r for r in rows if r[0] == g):
            assert out[g, k] == (at, total)
            at += n


# benchmark search


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def plain_hits(docs, items):
    windows = defaultdict(set)
    for item_id, t in items:
        w = words_of(t)
        k = min(10, len(w))
        for a in range(len(w) - k + 1 if k else 0):
            windows[tuple(w[a : a + k])].add(item_id)
    out = []
    for doc_id, t in docs:
        w, hit, of = words_of(t), set(), set()
        for k in {len(x) for x in windows}:
            for a in range(len(w) - k + 1):
                if tuple(w[a : a + k]) in windows:
                    hit |= set(range(a, a + k))
                    of |= windows[tuple(w[a : a + k])]
        names = sorted(str(i) for i in of if i is not None)
        out.append((doc_id, len(w), len(hit), len(names), sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def make_texts(seed, short):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abéŽ0") for _ in range(rng.randrange(1, 4)))
    text = lambda n: "".join(word() + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.randrange(10, 40))) for i in range(30)] + [(None, text(12)), (3, text(15)), (40, None), (41, "!?"), (42, "")]
    items += [(43, items[0][1]), (43, items[0][1])]
    if short:
        items += [(50 + k, text(k)) for k in range(1, 10)]
    docs = [(1, None), (None, ""), (2, "... !"), (3, items[0][1].upper()), (3, items[0][1].upper()), (4, " ".join(i[1] or "" for i in items))]
    for i in range(150):
        docs.append((10 + i, " ".join(rng.choice([text(8), (rng.choice(items)[1] or "")[rng.randrange(9) :], text(1)]) for _ in range(rng.randrange(1, 12)))))
    return docs, items


@pytest.mark.parametrize(("seed", "short", "small"), [(1, False, False), (2, True, False), (3, True, True)])
def test_hits(spark, monkeypatch, seed, short, small):
    if small:  # crowded tables, pieces within texts
        monkeypatch.setattr(decontaminate, "SHIFTS", 3)
        monkeypatch.setattr(decontaminate, "BITS", 6)
        monkeypatch.setattr(decontaminate, "PIECE", 40)
    docs, items = make_texts(seed, short)
    d = spark.createDataFrame([(*r, "clash", 1) for r in docs], "doc_id long, text string, window string, row int").repartition(3)
    b = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    assert found(decontaminate.hits(d, b)) == plain_hits(docs, items)


def test_hits_of_empty_tables(spark):
    d, b = spark.createDataFrame([(1, "some words")], "doc_id long, text string"), spark.createDataFrame([(1, "some words")], "item_id long, text string")
    assert found(decontaminate.hits(d.limit(0), b)) == []
    assert found(decontaminate.hits(d, b.limit(0))) == [(1, 2, 0, 0, sha256(b"").hexdigest(), False)]


def test_search_skips():
    """Ends of windows are found while most places are never looked at."""
    rng = random.Random(1)
    text = [f"w{rng.randrange(5000)}" for _ in range(20000)]
    item = [f"v{k}" for k in range(30)]
    text[7000:7030] = item
    hashes = decontaminate.words(" ".join(text).encode())[2]
    table = object.__new__(decontaminate.Tables)
    table.widths, table.shifts, table.bits = [10], 16, 16
    table.move, table.word = np.full(1 << 16, 255, "u1"), np.zeros(1 << 11, "u4")
    windows = [" ".join(item[a : a + 10]).encode() for a in range(21)]
    batch = decontaminate.batch_of("width int, window binary", [(10, w) for w in windows])
    for rows in decontaminate._entries(16, 16)([batch]):
        for slot, value in zip(rows.column("slot").to_pylist(), rows.column("value").to_pylist(), strict=True):
            if slot >= 0:
                table.move[slot] = min(table.move[slot], value)
            else:
                table.word[-1 - slot] |= value
    looked = []
    runs = decontaminate._runs
    decontaminate._runs = lambda h, ends, width: (looked.append(len(ends)), runs(h, ends, width))[1]
    try:
        assert table.ends(hashes, 10).tolist() == list(range(7009, 7030))
    finally:
        decontaminate._runs = runs
    assert sum(looked) < len(text) / 5
