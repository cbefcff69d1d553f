import json
from collections import Counter

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import attribution, chat, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", None, "One. Two three.\nFour\n\n\nfive  six ", " lead space. x", "\n", "é. ü x\n日本 語。", "<|endoftext|> it's 12", "word " * 3000, "a.  b\t c. d", "same. text", "same. text"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 2 else None, t, 1, "k") for i, t in enumerate(TEXTS)], "doc_id long, text string, section int, kind string").repartition(2)


def plain(text, tok, rule):
    """Counts by section, token by token of the whole text."""
    spans, at, out, crossing = attribution.lead_and_lines(text), 0, Counter(), Counter()
    for token in tok.encode(text, add_special_tokens=False).tokens:
        a, b = at, at + len(token)
        at = b
        shared = [min(b, y) - max(a, x) for _, x, y in spans]
        owner = max(range(len(spans)), key=lambda s: (shared[s], -s)) if rule == "majority" else next(s for s, (_, x, y) in enumerate(spans) if x <= a < y)
        out[owner] += 1
        crossing[owner] += not any(x <= a and b <= y for _, x, y in spans)
    assert at == len(text.encode()) == spans[-1][2]
    return [(k, *s, out[k], crossing[k]) for k, s in enumerate(spans)]


@pytest.mark.parametrize("rule", attribution.RULES)
def test_counts(spark, docs, rule):
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    want = sorted(((r.doc_id, *x) for r in docs.collect() for x in plain(r.text or "", tok, rule)), key=str)
    assert sorted(map(tuple, attribution.token_counts(docs, PATH, rule).collect()), key=str) == want
    assert attribution.token_counts(docs.limit(0), PATH, rule).count() == 0


def test_documents(spark):
    tok = Tokenizer.from_file(PATH)
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    out = queries.op7_attribution(spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, out.collect())) == sorted((r.doc_id, *x) for r in rows for x in plain(r.text, tok, "majority"))
    assert out.where("n_crossing > 0").count() > 50


def test_fields(spark):
    """Fields are encoded as one text; their tokens add up to the whole text's, which holds tokens across fields."""
    rows = [(1, "A title", 3, "Some body.\n\nMore"), (None, None, None, ""), (2, "x ", None, " y é"), (2, "x ", None, " y é"), (3, "", 7, None)]
    table = spark.createDataFrame([(*r, "kept out") for r in rows], "doc_id long, `a.title` string, n int, body string, text string")
    tok = Tokenizer.from_file(PATH)
    tok.encode_special_tokens = True
    for between in ("\n", ""):
        want = []
        for doc_id, *values in rows:
            closed = [("" if v is None else str(v)) + between * (i < 2) for i, v in enumerate(values)]
            ends = [len("".join(closed[: i + 1]).encode()) for i in range(3)]
            spans, counts, crossing, at = list(zip([0, *ends], ends, strict=False)), [0] * 3, [0] * 3, 0
            for token in tok.encode("".join(closed), add_special_tokens=False).tokens:
                held = [max(0, min(at + len(token), b) - max(at, a)) for a, b in spans]
                at += len(token)
                counts[held.index(max(held))] += 1
                crossing[held.index(max(held))] += max(held) < len(token)
            want += [(doc_id, i, name, *spans[i], counts[i], crossing[i]) for i, name in enumerate(("a.title", "n", "body"))]
        found = attribution.field_counts(table, PATH, ["a.title", "n", "body"], between=between)
        assert sorted(map(tuple, found.collect()), key=str) == sorted(want, key=str)
    assert attribution.field_counts(table.limit(0), PATH, ["n"]).count() == 0
    with pytest.raises(ValueError):
        attribution.field_counts(table, PATH, [])


def test_parts(monkeypatch):
    """Texts beyond a part's length have the tokens of the whole text."""
    texts = ["ab cd  ef\n gh 12 é 日本 語 " * 40, "x" * 300, " ", "", "a \x1c b \x85 c d e" * 30, "it's <|endoftext|> ok " * 30]
    whole = [attribution.token_lengths(PATH, t).tolist() for t in texts]
    monkeypatch.setattr(attribution, "PART", 7)
    assert all("".join(attribution.parts(t)) == t for t in texts) and len([*attribution.parts(texts[0])]) > 50
    assert [attribution.token_lengths(PATH, t).tolist() for t in texts] == whole


def test_gaps():
    import numpy as np

    count, crossing = attribution.allocate(np.array([2, 4, 3, 1]), np.array([1, 4]), np.array([3, 6]), "majority")
    assert count.tolist() == [1, 1] and crossing.tolist() == [1, 1]


def test_conversations(spark):
    sf = "/root/testdata/sf0.01"
    out = queries.op8_chat(spark, sf)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    assert sorted(map(tuple, out.collect())) == sorted(con.sql(chat.SQL).fetchall())
    assert all(json.dumps(json.loads(r.json), ensure_ascii=False, separators=(",", ":"), sort_keys=True) == r.json for r in out.collect())


def test_links_order_and_schemas(spark):
    schemas = {"add": {"a": ("integer", True), "b": ("number", False), "note": ("string", False)}, "none": {}}
    calls = spark.createDataFrame(
        [
            ("x", "add", '{"b": 1.5, "a":1}', ["w", "w"], "extra"), ("w", "add", '{"a":"1"}', [], "extra"), ("v", "none", "{}", ["x", "w", "gone"], None), ("v", "none", "{}", ["x"], None),
            ("p", "add", '{"b":true,"zz":[1]}', ["q"], None), ("q", "add", "[1]", ["p"], None), ("r", "other", "not json", ["q"], None), (None, "none", None, None, None), ("s", "none", '{"k":null}', ["s"], None),
        ],
        "call_id string, name string, arguments string, depends_on array<string>, content string",
    )
    results = spark.createDataFrame([("x", 5, "late"), ("x", 2, "early \"q\"\n"), ("x", 2, "early z"), (None, 1, "n"), ("lost", 1, "n")], "call_id string, turn long, content string")
    rows = {r.call_id: r for r in chat.format_calls(calls, results, schemas).collect()}
    assert {k: r.level for k, r in rows.items()} == {"w": 0, "x": 1, "v": 2, "p": None, "q": None, "r": None, "s": None, None: None}
    assert {k: [*r.errors] for k, r in rows.items()} == {
        "x": [], "w": ["a: not integer"], "v": [], "p": ["a: missing", "b: not number", "zz: unknown"], "q": ["not an object"], "r": ["unknown tool"], "s": ["k: unknown"], None: ["not an object"],
    }
    assert rows["x"].json == '{"arguments":{"a":1,"b":1.5},"id":"x","name":"add","result":"early \\"q\\"\\n"}' and rows["x"].n_results == 3
    assert rows["w"].json == '{"arguments":{"a":"1"},"id":"w","name":"add","result":null}'
    assert rows["r"].json == '{"arguments":{"text":"not json"},"id":"r","name":"other","result":null}'
    assert chat.format_calls(calls, results, schemas).count() == 9
    assert chat.format_calls(calls.limit(0), results.limit(0), schemas).count() == 0


def test_odd_turns(spark):
    turns = spark.createDataFrame([(1, 0, "user", None), (1, 1, "assistant", None), (None, 2, "user", "x"), (1, 2, "user", ""), (1, 2, "user", ""), (2, None, "assistant", "y"), (3, 1, None, "z")], "conv_id long, turn long, role string, text string")
    rows = chat.format_calls(*chat.conversation_calls(turns), chat.ASK).collect()
    assert sorted((str(r.call_id), r.level, r.n_results, r.valid) for r in rows) == [("1:0", 0, 1, False), ("1:2", 1, 0, True), ("1:2", 1, 0, True), ("None", None, 0, True)]


def plain_levels(parents):
    """Levels by Kahn's passes; calls on a cycle or behind one have none."""
    parents = {c: set(p) & parents.keys() for c, p in parents.items()}
    out = {}
    while True:
        front = {c: max((out[p] + 1 for p in ps), default=0) for c, ps in parents.items() if c not in out and ps <= out.keys()}
        if not front:
            return out
        out |= front


def test_levels(spark):
    """A chain of 2,000 calls, a hub, random parents, cycles and what hangs on them; the plan stays small."""
    import random

    rng = random.Random(5)
    parents = {f"a{k}": [f"a{k - 1}"] for k in range(2000)} | {f"h{k}": ["a7"] for k in range(300)}
    parents |= {f"d{k}": [f"d{rng.randrange(max(1, k))}" for _ in range(rng.randrange(4))] if k else [] for k in range(120)}
    parents |= {f"s{k}": [f"s{k - 1}", "a3", "nowhere"] if k % 5 == 0 else [f"s{k - 1}"] for k in range(60)}
    parents |= {"c0": ["c2"], "c1": ["c0"], "c2": ["c1", "a1"], "c3": ["c2"], "c4": ["c3", "h1"], "e0": ["e1"], "e1": ["e0"], "e2": ["e1"], "self": ["self"]}
    rows = [*parents.items(), ("h1", ["a7"]), (None, ["a1"]), ("free", None)]
    found = chat.levels(spark.createDataFrame(rows, "call_id string, depends_on array<string>").repartition(3))
    assert {r.call_id: r.level for r in found.collect()} == plain_levels(parents | {"free": []}) and found.count() == len(plain_levels(parents)) + 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("\n") < 60
    assert chat.levels(spark.createDataFrame([], "call_id string, depends_on array<string>")).count() == 0


def test_every_turn_has_a_row(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "user", "q\n"), (1, 2, "assistant", "a"), (1, 4, "assistant", None), (1, 5, "user", ""), (1, 5, "user", ""), (2, 1, None, "x"), (None, 1, "user", "y"), (3, None, "assistant", "z")]
    rows = chat.turn_rows(spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, call_id string")).collect()
    found = sorted((str(r.conv_id), str(r.turn), r.kind, str(r.call_id), r.linked) for r in rows)
    assert found == sorted([("1", "0", "text", "None", False), ("1", "1", "call", "1:1", True), ("1", "2", "result", "1:1", True), ("1", "4", "result", "1:3", False), ("1", "5", "call", "1:5", False), ("1", "5", "call", "1:5", False), ("2", "1", "text", "None", False), ("None", "1", "call", "None", False), ("3", "None", "result", "None", False)])
    assert next(r.json for r in rows if r.turn == 1 and r.conv_id == 1) == '{"content":"q\\n","role":"user"}'
    assert next(r.json for r in rows if r.conv_id == 2) == '{"content":"x","role":null}'
