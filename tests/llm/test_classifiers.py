import itertools
import zlib

import numpy as np
import pytest

from tideline.llm import quality, queries, toxicity

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (None, ""), (2, "w " * 20_000), (2, "w " * 20_000), (3, "\n\n\n"), (4, "i.d-i o t 1d10t \x00 ﬁ \U0001f642"), (5, "!!! *** 123"), (6, "a" * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, 0.5, "x") for r in ODD], "doc_id long, text string, score double, y string").repartition(2)


def test_forward_backward():
    rng = np.random.default_rng(1)
    sizes = [3, 1, 4, 1, 2]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad, move = rng.normal(size=starts[-1]), rng.normal(size=(2, 2))
    marginal, pairs, log_z = quality.forward_backward(bad, starts, move)
    want, want_pairs, want_z = np.zeros(len(bad)), np.zeros((2, 2)), 0.0
    for a, b in itertools.pairwise(starts):
        paths = [*itertools.product((0, 1), repeat=b - a)]
        w = np.array([np.exp(sum(bad[a + i] for i, s in enumerate(p) if s) + sum(move[x, y] for x, y in itertools.pairwise(p))) for p in paths])
        want_z += np.log(w.sum())
        for p, x in zip(paths, w / w.sum(), strict=True):
            want[a:b] += x * np.array(p)
            for i, j in itertools.pairwise(p):
                want_pairs[i, j] += x
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs) and np.isclose(log_z, want_z)


def test_quality(spark, odd):
    rows = queries.op2_quality(spark, SF).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.97
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"), sample=200)
    out = quality.score(odd, model, ("doc_id", "y")).collect()
    assert len(out) == len(ODD) and {r.y for r in out} == {"x"} and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 2}) == 1
    assert quality.score(odd.limit(0), model).count() == 0
    lines = quality.line_labels(odd, model).collect()
    assert sorted(r.line for r in lines if r.doc_id == 3) == [0, 1, 2, 3] and all(0 <= r.bad <= 1 for r in lines)


def test_no_labels(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.score(odd, quality.fit(odd, none)).collect()} == {0.5}
    assert len({r.score for r in toxicity.score(odd, toxicity.fit(odd, none)).collect()}) == 1


def test_decode(spark):
    docs = spark.createDataFrame([(1, "the idiot and the loser said the worthless thing to this clown " * 50)], "doc_id long, text string")
    cost = toxicity.language_model(toxicity.count_trigrams(docs))
    assert np.allclose(np.exp(-cost).sum(2), 1, atol=1e-3)
    for noisy, plain in {"1d10t": "idiot", "i.d.i.o.t": "idiot", "i d i o t": "idiot", "l0s3r!!": "loser", "looooooser": "loser", "w0rthl3$$": "worthless", "(clown)": "clown", "idiot": "idiot"}.items():
        assert toxicity.restore(noisy, cost) == [plain]
    assert toxicity.restore("12,34", cost) == [] and toxicity.spaced("an i d i o t a b".split()) == ["i d i o t a b"]


def test_viterbi_is_exact():
    """Against all paths of small lattices."""
    rng = np.random.default_rng(2)
    cost = rng.random((64, 64, 64)).astype("f4")

    def paths(token, i=0):
        if i == len(token):
            yield 0.0, ""
            return
        c = token[i]
        arcs = [(0.0, c)] if c.isalpha() else [(toxicity.LOOK_ALIKE, x) for x in toxicity.LEET.get(c, "")] + [(p + (toxicity.LOST if c in toxicity.LEET else 0), x) for p, x in ((toxicity.MARK, ""), (toxicity.BREAK, " "))]
        for price, x in arcs:
            for rest, text in paths(token, i + 1):
                yield price + rest, x + text

    def price(text):
        a = b = 0
        total = 0.0
        for c in text + " ":
            s = toxicity.symbol(c)
            total += cost[a if b else 0, b, s]
            a, b = (0, 0) if s == 0 else (b, s)
        return total

    for token in ("a1b", "1", "x.y1", "0a$b", "q1|1"):
        best = min(((p + price(" ".join(t.split())) if t.strip() else p + price(""), t) for p, t in paths(token) if "  " not in t and t[:1] != " " and t[-1:] != " "), key=lambda r: r[0])
        assert toxicity.decode(token, cost) == best[1].split() 


def test_toxicity(spark, odd):
    rows = queries.op5_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in held]) > 0.9
    assert not sum(a and not b for a, b in held)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    out = toxicity.score(odd, model, ("doc_id", "y")).collect()
    assert len(out) == len(ODD) and all(0 <= r.score <= 1 for r in out)
    assert {r.score > 0.3 for r in out if r.doc_id == 4} == {True}
    assert toxicity.score(odd.limit(0), model).count() == 0


def test_look_alikes_at_edges_and_doubled_letters(spark):
    text = "the idiot and the loser said the worthless stupid thing to this clown ass scum " * 50
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    cost = toxicity.language_model(toxicity.count_trigrams(docs))
    for noisy, plain in {"!diot": "idiot", "|diot": "idiot", "(lown": "clown", "s(um": "scum", '"!diot!!': "idiot", "@$$": "ass", "455": "ass", "iddiot": "idiot", "stuupid": "stupid"}.items():
        assert [plain] in toxicity.readings(noisy, cost), noisy
    # what is plain stays: doubled letters of real words, marks at edges
    for word, plain in {"worthless": "worthless", "ass": "ass", "loser!!": "loser", "(clown)": "clown", "(the": "the"}.items():
        assert toxicity.restore(word, cost) == [plain], word
    assert toxicity.readings("12,34", cost) == toxicity.readings("!!", cost) == [[]]
    found = toxicity._Found(cost, None)
    assert {"idiot", "clown", "ass", "stupid"} <= found.text("!DIOT (lown @$$ stuupid")


def test_bounded_sample(spark):
    """The bound counts rows; repeated ids count once, with the higher of two labels."""
    docs = spark.createDataFrame([(i % 40, f"text {i % 3}") for i in range(2000)] + [(None, "no id")], "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(2, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.labelled_sample(docs, labels, "toxic", 10).collect()
    assert len(rows) <= 10 and len(toxicity.labelled_sample(docs, labels, "toxic", 100).collect()) == 40
    assert toxicity.labelled_sample(docs.where("doc_id = 2"), labels, "toxic", 100).collect()[0].y == 1
