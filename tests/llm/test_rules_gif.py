import hashlib
import random
import struct
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from tideline.llm import gif, rules

TEXTS = ["", None, " \n\n\t ", "word " * 40, "a b c d e f g h i j a b c d e f g h x", "line one\nline one\n\nline two\nline one", "é#è* $%&|<> ñ\x0bx\x0cy\x1cz", "A B\n" * 30, "x" * 5000, " ".join(str(i) for i in range(300)), "same", "same"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i if i != 4 else None, t, 1, "x") for i, t in enumerate(TEXTS)] + [(10, "other", 2, "y")], "doc_id long, text string, failures int, kept string").repartition(3)


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_measures(docs):
    out = rules.verdicts(docs).collect()
    assert len(out) == docs.count()
    want = sorted((brute(r.text), r.doc_id is None, r.doc_id or 0) for r in docs.collect())
    assert sorted((tuple(r[m] for m in rules.MEASURES[:5]), r.doc_id is None, r.doc_id or 0) for r in out) == want
    for r in out:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_random_repeats():
    rng = random.Random(5)
    for _ in range(200):
        text = " ".join(rng.choice("abc") for _ in range(rng.randrange(60)))
        assert rules.measure_text(text)[:5] == brute(text)


def test_ablation(docs):
    entries = rules.ledger(docs)
    rows, bits = entries.collect(), {r: rules.mask((r,)) for r in rules.RULES}
    policy = rules.mask(rules.POLICIES["v2"])
    got = {r.rule: (r.n_failed, r.n_only, r.n_rejected) for r in rules.ablation(entries, "v2").collect()}
    for rule, bit in bits.items():
        assert got[rule] == (sum(bool(r.failures & bit) for r in rows), sum(r.failures & policy == bit for r in rows), sum(bool(r.failures & policy) for r in rows))
    assert rules.verdicts(docs.limit(0)).count() == 0


def test_sql(docs):
    out = rules.verdicts(docs).select("doc_id", *rules.MEASURES[:5], "base_failed", "kept")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, con.sql(rules.SQL).fetchall()))


# ---------------------------------------------------------------- GIF


def lzw(indices, size, clear_at=4096):
    """A plain writer with a growing dictionary, for the reader's test."""
    bits, count = 0, 0
    width, clear = size + 1, 1 << size

    def put(code):
        nonlocal bits, count
        bits |= code << count
        count += width

    put(clear)
    table, prefix = {(i,): i for i in range(clear)}, ()
    next_code = clear + 2
    for x in indices:
        if (*prefix, x) in table:
            prefix = (*prefix, x)
            continue
        put(table[prefix])
        if next_code < 4096:
            table[*prefix, x] = next_code
            next_code += 1
            if next_code > 1 << width and width < 12:
                width += 1
        elif clear_at:
            put(clear)
            table, next_code, width = {(i,): i for i in range(clear)}, clear + 2, size + 1
        prefix = (x,)
    if prefix:
        put(table[prefix])
        next_code += 1
        if next_code > 1 << width and width < 12 and next_code <= 4096:
            width += 1
    put(clear + 1)
    return bits.to_bytes((count + 7) // 8, "little")


@pytest.mark.parametrize("size", [2, 4, 8])
@pytest.mark.parametrize("clear_at", [4096, 0])
def test_lzw(size, clear_at):
    rng = random.Random(size)
    for n in (0, 1, 2, 3, 500, 30_000):
        for data in ([rng.randrange(1 << size) for _ in range(n)], [0] * n, [i // 7 % (1 << size) for i in range(n)]):
            assert gif.unlzw(lzw(data, size, clear_at), size, n) == bytes(data)
    assert gif.unlzw(b"", size, 3) == bytes(3)


def block(data):
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def picture(index, left, top, disposal, transparent=None, delay=5, local=None, interlaced=False):
    h, w = index.shape
    rows = index[np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])] if interlaced else index
    control = bytes([0x21, 0xF9, 4, disposal << 2 | (transparent is not None), delay, 0, transparent or 0, 0])
    return control + bytes([0x2C, left, 0, top, 0, w, 0, h, 0, (0x81 if local else 0) | (64 if interlaced else 0)]) + (local or b"") + b"\x02" + block(lzw(rows.reshape(-1).tolist(), 2))


def test_frames(spark):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    full, small = np.full((10, 4), 1), np.array([[2, 3], [3, 2]])
    local = bytes([9, 9, 9, 8, 8, 8, 200, 0, 0, 7, 7, 7])
    data = b"GIF89a" + bytes([4, 0, 10, 0, 0x81, 0, 0]) + palette + picture(full, 0, 0, 1, interlaced=True) + picture(small, 1, 1, 3, transparent=3) + picture(small, 0, 0, 2, local=local) + bytes([0x21, 0xFE]) + block(b"comment") + picture(small, 2, 2, 0, delay=7) + b"\x3b"
    shown = [*gif.read_gif(data)]
    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    assert len(shown) == 4 and (shown[0].canvas == red).all()
    assert tuple(shown[1].canvas[1, 1]) == green and tuple(shown[1].canvas[1, 2]) == red
    assert tuple(shown[2].canvas[1, 1]) == (200, 0, 0) and tuple(shown[2].canvas[2, 2]) == red  # restored after the second
    assert tuple(shown[3].canvas[0, 0]) == (0, 0, 0) and tuple(shown[3].canvas[2, 3]) == blue
    assert [(f.start_ms, f.delay_ms) for f in shown] == [(0, 50), (50, 50), (100, 50), (150, 70)]
    df = spark.createDataFrame([(1, data), (2, None), (3, b"junk"), (4, data[:60])], "doc_id long, media binary")
    rows = gif.frames(df, "doc_id", "media").orderBy("id", "frame").collect()
    assert [(r.id, r.frame, sum(r.histogram)) for r in rows] == [(1, k, 40) for k in range(4)] + [(4, 0, 40)] * (len(rows) - 4)


def test_payloads(spark, docs):
    for n in (64, 128, 254 * 64, 64 * 4096, 64 * 4097 + 64 * 4096):
        payload = random.Random(n).randbytes(n)
        assert gif.read_samples(gif.read_gif(gif.write_samples(payload))) == payload
    out = gif.read_texts(gif.store_texts(docs)).collect()
    texts = {(r.doc_id, len((r.text or "").encode())): (r.text or "").encode() for r in docs.collect()}
    assert len(out) == docs.count()
    for r in out:
        data = texts[r.doc_id, r.n_bytes]
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, sum(r.histogram)) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload))
    assert gif.read_texts(gif.store_texts(docs.limit(0))).count() == 0


def plain_reader(stream, size):
    """Bytes of a code stream, bit by bit."""
    bits, at, width, clear, out, table, last = int.from_bytes(stream, "little"), 0, size + 1, 1 << size, b"", {}, None
    while True:
        code, at = bits >> at & (1 << width) - 1, at + width
        if code == clear:
            table, width, last = {i: bytes([i]) for i in range(clear)} | {clear: None, clear + 1: None}, size + 1, None
        elif code == clear + 1:
            assert (at + 7) // 8 == len(stream)
            return out
        else:
            found = table[code] if code in table else last + last[:1]
            if last is not None and len(table) < 4096:
                table[len(table)] = last + found[:1]
            width = min(12, max(width, len(table).bit_length()))
            last, out = found, out + found


def test_writer():
    """What the writer makes is read back by a plain reader, and is a plain writer's stream until a table is full."""
    rng = random.Random(8)
    for data in (b"", b"a", b"aaaaaaa", rng.randbytes(30_000), b"the cat and the hat " * 4000, bytes(20_000)):
        assert plain_reader(gif.lzw(data), 8) == data == gif.unlzw(gif.lzw(data), 8, len(data))
        assert gif.lzw(data[:3000]) == lzw([*data[:3000]], 8)


def test_broken():
    """Bad code sizes end a file's frames, and a header alone can't ask for memory."""
    head = b"GIF89a" + bytes([4, 0, 4, 0, 0x81, 0, 0]) + bytes(12)
    good = picture(np.full((4, 4), 1), 0, 0, 1)
    for size in (0, 9, 11, 12, 200, 255):
        bad = good[:18] + bytes([size]) + good[19:]
        assert len([*gif.read_gif(head + good + bad + good + b"\x3b")]) == 1 and [*gif.read_gif(head + bad)] == []
    assert [*gif.read_gif(b"GIF89a" + b"\xff" * 4 + head[10:] + good)] == []
    wide = good[:8] + struct.pack("<BHHHHB", 0x2C, 0, 0, 65535, 65535, 0) + good[18:]
    assert [*gif.read_gif(head + wide)] == []


def test_ablations(spark):
    """Every policy's rules by counting rows of the ledger."""
    texts = ["few words", "x " * 60, " ".join(f"w{k} #" for k in range(40)), "\n".join(["same line of some words"] * 9 + [f"line {k} with words" for k in range(9)]), " ".join(f"good{k} word" for k in range(30)), None, "A" * 3000]
    docs = spark.createDataFrame([(k % 5, t, 1) for k, t in enumerate(texts * 3)], "doc_id long, text string, failures int").repartition(2)
    entries = [{r for i, r in enumerate(rules.RULES) if x.failures >> i & 1} for x in rules.ledger(docs).collect()]
    want = set()
    for policy, names in rules.POLICIES.items():
        for r in names:
            own = [e & {*names} for e in entries]
            want.add((policy, r, sum(r in e for e in own), sum(e == {r} for e in own), sum(bool(e) for e in own)))
    assert {tuple(r) for r in rules.ablations(docs).collect()} == want
    assert rules.ablations(docs.limit(0)).count() == 0


def test_stored_frames(spark, tmp_path):
    texts = [(1, "a" * 64), (2, None), (3, "b" * (gif.WIDTH * gif.ROWS + 5)), (3, "b" * (gif.WIDTH * gif.ROWS + 5))]
    media = gif.store_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    odd = spark.createDataFrame([(9, 0, b"no gif"), (8, 0, None)], media.schema)
    rows = gif.store_frames(media.unionByName(odd), "doc_id", "media", f"file://{tmp_path}/frames").collect()
    assert sorted((r.id, r.frame, r.start_ms) for r in rows) == [(1, 0, 0), (2, 0, 0), (3, 0, 0), (3, 0, 0), (3, 1, 100), (3, 1, 100)]
    assert all(sum(r.histogram) == r.width * r.height and r.delay_ms == 100 for r in rows)
    grey = np.full((1, 64, 3), ord("a"), "u1")
    assert next(r for r in rows if r.id == 1).canvas_sha256 == hashlib.sha256(grey.tobytes()).hexdigest()
    assert len({r.canvas_sha256 for r in rows if r.id == 3}) == 2
    again = spark.read.parquet(f"file://{tmp_path}/frames")
    assert again.count() == 6


@pytest.mark.parametrize("size", [2, 8])
def test_strings_by_places(size):
    """Strings are taken from earlier places of the output as a table of strings would give them, and no further than asked for."""
    clear, rng = 1 << size, random.Random(size)
    for _ in range(200):
        codes = [rng.randrange(clear)]
        while len(codes) < 60:
            codes.append(rng.choice([rng.randrange(clear), clear + 2 + rng.randrange(len(codes))]))
        if rng.random() < 0.3:
            codes[rng.randrange(1, 60)] = clear + 70  # names an entry that isn't there
        table, want, last = [bytes([i]) for i in range(clear)] + [b"", b""], b"", b""
        for c in codes:
            if c > len(table):
                break
            entry = table[c] if c < len(table) else last + last[:1]
            want += entry
            if last:
                table.append(last + entry[:1])
            last = entry
        out = bytearray(b"before")
        gif._expand(np.array(codes), clear, out, 1 << 20)
        assert bytes(out) == b"before" + want
    out = bytearray()
    gif._expand(np.array([0, *range(clear + 2, 4096)]), clear, out, 1000)  # stands for millions of bytes
    assert 1000 <= len(out) < 1100
