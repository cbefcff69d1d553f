import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm import queries

SF = "/root/testdata/sf0.01"
ROWS = [(1, None), (2, ""), (2, ""), (3, "one two three four five six seven"), (3, "one two three four five six seven"), (4, "ONE two three four five six seven"), (None, "one two three four five six seven"), (None, None), (5, "w " * 3000)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7) for i, t in ROWS], "doc_id long, text string, lang string, source string, n_chars long, key int").withColumn("score", F.lit("s")).repartition(2)


def test_stages(spark):
    docs = queries.documents(spark, SF)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = {r.doc_id: r.text for r in docs.collect()}
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), name)
        assert docs.columns == columns
        rows = docs.collect()
        kept[name] = {r.doc_id for r in rows}
        assert len(rows) == len(kept[name]) and all(r.n_chars == len(r.text) for r in rows)
    toxic = {i for i, r in labels.items() if r.toxic}
    assert len(toxic & kept["toxicity"]) < 0.4 * len(toxic) and len([i for i in labels if i not in toxic and i not in kept["toxicity"]]) < 5
    good = {i for i in kept["toxicity"] & labels.keys() if labels[i].quality}
    assert len(good - kept["quality"]) <= 2 and not [i for i in kept["quality"] & labels.keys() if not labels[i].quality][5:]
    assert kept["near_duplicates"] == kept["repeated_passages"] < kept["quality"]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert pieces.select("doc_id").distinct().count() == len(rows)
    # what plain versions of the near-duplicate and the passage stages keep
    from tests_llm_plain import near_kept, without_passages

    assert kept["near_duplicates"] == near_kept({i: before[i] for i in kept["quality"]}, 5, 80)
    texts = {r.doc_id: r.text for r in rows}
    want = without_passages({i: before[i] for i in kept["near_duplicates"]}, 200, 50)
    assert all(len(want[i]) <= len(t.encode()) <= len(want[i]) + 12 for i, t in texts.items())
    assert sum(texts[i] != before[i] for i in texts) > 20


def test_passages(spark):
    """A passage of 51 words goes from every document that holds it, wherever it stands; one of 50 words stays."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    long, short = text(51), text(50)
    rows = [(k, f"{text(30)}{chr(65 + k)} {(long, short)[k % 2]} {chr(65 + k)}{text(20)}") for k in range(12)] + [(100 + k, text(80)) for k in range(5)]
    out = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), SF).collect()}
    assert all(out[i] == t for i, t in rows if long not in t)
    assert not any(long in out[i] for i, t in rows) and all(short in out[k] for k in range(1, 12, 2))


def test_odd_rows(spark, odd):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, SF)
        assert out.columns == odd.columns
        assert out.count() == {"toxicity": 9, "near_duplicates": 5, "repeated_passages": 9}.get(name, out.count())
        assert stage(spark, odd.limit(0), SF).count() == 0
    near = corpus_pipeline.drop_near_duplicates(spark, odd, SF)
    found = sorted((str(r.doc_id), r.text) for r in near.select("doc_id", F.substring("text", 1, 3).alias("text")).fillna("", ["text"]).collect())
    assert found == [("1", ""), ("2", ""), ("3", "one"), ("5", "w w"), ("None", "")]


def test_clashing_columns(spark):
    """User columns named as the stages' own keep their names, types and values, and change nothing else."""
    rows = [(i, t, "en", "s", len(t or "")) for i, t in [*ROWS, (6, "p" * 450 + " six"), (7, "p" * 450 + " seven")]]
    plain = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, n int")
    own = {"key": F.concat(F.lit("k"), "n"), "score": F.concat(F.lit("s"), "n"), "m": F.col("n") + 1, "rest": F.col("n") + 2, "__text": F.col("n") + 3, "__first": F.col("n") + 4, "again": F.col("n") + 5, "given": F.col("n") + 6, "a.b": F.col("n") + 7, "map": F.create_map(F.lit("n"), "n")}
    more = plain.withColumns(own).repartition(2)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out, want = stage(spark, more, SF), stage(spark, plain, SF)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in more.schema], name
        found = [r.asDict() for r in out.collect()]
        for r in found:
            n = r["n"]
            assert [r[c] for c in own] == [f"k{n}", f"s{n}", *range(n + 1, n + 8), {"n": n}], name
        # which of a document's repeated rows stays is open, so a row's number isn't compared
        assert sorted((str(r["doc_id"]), r["text"] or "", r["n_chars"]) for r in found) == sorted((str(r.doc_id), r.text or "", r.n_chars) for r in want.collect()), name


def test_one_of_each_group(spark):
    """Groups without ids, and groups whose rows share one id, keep one document too; what is not linked stays."""
    w, v = (" ".join(f"{c}{k}" for k in range(100)) for c in "wv")
    rows = [(None, f"a {w}"), (None, f"b {w}"), (7, f"ONE {v.upper()} 1"), (7, f"one {v} 2"), (7, "some quite different words of one more text"), (8, ""), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    assert sorted(str(i) for i, _ in out) == ["7", "7", "8", "None", "None"] and set(out) <= set(rows)
    assert sorted(t[:1] for i, t in out if i is None) in (["", "a"], ["", "b"])
    assert (7, rows[4][1]) in out and len({t for i, t in out if i == 7}) == 2
