"""Toxicity by noisy-channel deobfuscation.

A text's words are seen as noisy spellings: leetspeak, letters spaced or dotted apart, letters repeated or doubled. A
word with such marks becomes a character lattice, and Viterbi decoding under a character trigram model of the whole
corpus finds the likeliest plain spelling; other words are their own only path. A mark at a word's edge that is also a
look-alike (``!``, ``|``, ``(``) may be either, and both readings count. Words of look-alikes alone are words; numbers
with marks inside aren't. The restored words and their beginnings are then
scored by a logistic model.

The character counts cover every document and come as one table of at most 64^3 rows. The scorer is learned from a
bounded sample of labelled rows (SAMPLE), from every feature that has evidence there. Null and empty texts have no
words: the model's intercept is their score. Repeated rows get equal scores, ties and very long texts nothing special
(a text is read word by word); empty tables give no rows, and without labels of both kinds the score is one constant.
Clashing columns: ``score`` gives the columns in ``keep`` unchanged, so these mustn't be called ``score``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch_from, batch_of, id_and_text, written

#: Labelled rows that the scorer is learned from at most, lengths of beginnings.
SAMPLE, BEGINNINGS = 20_000, (4, 5, 6)
#: What the channel costs, in natural-log units: a look-alike, a dropped mark, a dropped repetition, a break kept; and
#: what it costs more to drop or break at a look-alike, and what to drop one of just two equal letters.
LOOK_ALIKE, MARK, REPEAT, BREAK, LOST, DOUBLE = 0.5, 0.7, 0.3, 1.5, 8.0, 5.0
#: Letters that a digit or sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "+": "t", "|": "il", "(": "c", "€": "e", "£": "l"}
MARKS = set(" .-_*~'/\\,:;#&%=^`")
_OUTER = "".join(MARKS) + '!?"()[]{}<>|«»“”…'
_BARE = "".join(c for c in _OUTER if c not in LEET)
_DOUBLED = re.compile(r"(\w)\1").search


def _symbols() -> np.ndarray:
    """The model's symbol of a code point below U+0180: 0 for what is no letter, 1 to 26 for a to z, then the others."""
    out = np.zeros(0x180, "i4")
    for c in range(0x180):
        if chr(c).isalpha():
            out[c] = c - 96 if 97 <= c <= 122 else 27 + c % 37
    return out


_TABLE = _symbols()


def symbol(c: str) -> int:
    code = ord(c)
    return int(_TABLE[code]) if code < 0x180 else 27 + code % 37 if c.isalpha() else 0


def trigrams(text: str) -> np.ndarray:
    """Indices of the symbol trigrams of a lower-cased text; what precedes a word's break doesn't count."""
    codes = np.frombuffer(f"  {text} ".encode("utf-32-le", "surrogatepass"), "<u4")
    s = np.where(codes < 0x180, _TABLE[np.minimum(codes, 0x17F)], 27 + codes % 37).astype("i4")
    first, middle, last = s[:-2], s[1:-1], s[2:]
    return np.where(middle == 0, 0, first) << 12 | middle << 6 | last


def count_trigrams(docs: DataFrame) -> DataFrame:
    """``trigram, n`` over all documents."""

    def run(batches):
        total = np.zeros(1 << 18, "i8")
        for batch in batches:
            some, size = [], 0
            for text in batch.column("text").to_pylist():
                some.append(text)
                size += len(text)
                if size > 300_000:
                    total += np.bincount(trigrams("  ".join(some).lower()), minlength=1 << 18)
                    some, size = [], 0
            total += np.bincount(trigrams("  ".join(some).lower()), minlength=1 << 18)
        found = np.flatnonzero(total)
        yield batch_from("trigram int, n long", trigram=found.astype("i4"), n=total[found])

    return id_and_text(docs).select("text").mapInArrow(run, "trigram int, n long").groupBy("trigram").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Costs (negative natural logs) of a symbol after two others, interpolated with shorter contexts."""
    c = np.zeros(1 << 18)
    for row in counts.collect():  # at most 64^3 rows
        c[row.trigram] = row.n
    c = c.reshape(64, 64, 64)
    one = (c.sum((0, 1)) + 1) / (c.sum() + 64)
    two = c.sum(0)
    two = (two + 20 * one) / (two.sum(1, keepdims=True) + 20)
    return -np.log((c + 20 * two[None]) / (c.sum(2, keepdims=True) + 20)).astype("f4")


def decode(token: str, cost: np.ndarray, inner: tuple[int, int] | None = None) -> list[str]:
    """The likeliest plain words behind a noisy lower-case token (its letters may stand apart by spaces).

    Outside the range ``inner`` a look-alike may be a plain mark, so it costs no more than one to drop.
    """
    low, high = inner or (0, len(token))
    # state: the last two symbols; best: cost and spelling, a space where a word breaks
    best: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
    for i, c in enumerate(token):
        arcs: list[tuple[float, str]] = []
        if c.isalpha():
            arcs.append((0.0, c))
            if i >= 1 and token[i - 1] == c:
                arcs.append((REPEAT if token[max(0, i - 2) : i] == c * 2 or token[i : i + 2] == c * 2 else DOUBLE, ""))
        else:
            more = LOST if c in LEET and low <= i < high else 0.0
            arcs += [(LOOK_ALIKE, x) for x in LEET.get(c, "")]
            arcs += [(MARK + more, ""), (BREAK + more, " ")]
        after: dict[tuple[int, int], tuple[float, str]] = {}
        for (a, b), (spent, text) in best.items():
            for price, x in arcs:
                if not x or (x == " " and b == 0):
                    state, total, spelt = (a, b), spent + price, text
                else:
                    s = 0 if x == " " else symbol(x)
                    state, total, spelt = (0 if s == 0 else b, s), spent + price + float(cost[a if b else 0, b, s]), text + x
                if state not in after or total < after[state][0]:
                    after[state] = (total, spelt)
        best = after
    ended = min((spent + float(cost[a if b else 0, b, 0]), text) for (a, b), (spent, text) in best.items())
    return ended[1].split()


def readings(word: str, cost: np.ndarray) -> list[list[str]]:
    """The plain words behind one lower-case word of a text; then those with its edges' look-alikes as letters."""
    core, token = word.strip(_OUTER), word.strip(_BARE)
    if token.isalpha():
        return [decode(token, cost) if _DOUBLED(token) else [token]]
    if not core or not (any(map(str.isalpha, core)) or all(c in LEET for c in core)):
        return [[]]
    low = len(token) - len(token.lstrip(_OUTER))
    high = low + len(core)
    inner = dict.fromkeys([(low, high), (0, high), (low, len(token)), (0, len(token))])
    return [decode(token, cost, x) for x in inner]


def restore(word: str, cost: np.ndarray) -> list[str]:
    """The likeliest plain words behind one lower-case word of a text."""
    return readings(word, cost)[0]


def spaced(words: list[str]) -> list[str]:
    """Runs of three and more one-letter words, each as one token with its spaces."""
    sizes = bytes(map(min, map(len, words), [2] * len(words)))
    return [" ".join(words[m.start() : m.end()]) for m in re.finditer(b"\x01{3,}", sizes)] if b"\x01\x01\x01" in sizes else []


def features(plain: list[str]) -> list[str]:
    """A restored word's features: itself and its beginnings."""
    return [f for w in plain for f in (w, *(w[:n] + "~" for n in BEGINNINGS if len(w) > n))]


class _Found(dict):
    """Features of a word that are in ``kept`` (all if None), cached by a Python worker within bounds."""

    def __init__(self, cost: np.ndarray, kept: dict[str, int] | None):
        super().__init__()
        self.cost, self.kept, self.old = cost, kept, {}

    def __missing__(self, word: str) -> tuple:
        out = self.old.get(word)
        if out is None:
            found = list(dict.fromkeys(f for plain in readings(word, self.cost) for f in features(plain)))
            out = tuple(found if self.kept is None else (self.kept[f] for f in found if f in self.kept))
        if len(self) >= 150_000:  # the words so far become the older ones; what comes again moves back
            self.old = dict(self)
            self.clear()
        self[word] = out
        return out

    def text(self, text: str) -> set:
        words = text.lower().split()
        return {f for w in (*set(words), *spaced(words)) for f in self[w]}


@dataclass
class Model:
    """Character costs, and the scorer: features with their places, weights and the intercept."""

    cost: np.ndarray
    kept: dict[str, int]
    weights: np.ndarray
    intercept: float


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int) -> DataFrame:
    """``text, y`` of at most ``bound`` labelled documents, dealt by a hash of their ids; a row for each id.

    Of labels that disagree the higher one counts; of texts that share an id, that of the least hash.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
    one = F.min(F.struct(F.xxhash64("text"), "text"))
    return id_and_text(docs).join(known, "doc_id").groupBy("doc_id").agg(F.first("y").alias("y"), one.alias("t")).select("t.text", "y")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learns from ``docs`` (character counts: all of them) and from labelled ones (at most ``sample``)."""
    spark = docs.sparkSession
    cost = language_model(count_trigrams(docs))
    shared = spark.sparkContext.broadcast(cost)
    train = written(labelled_sample(docs, labels, label, sample), "toxicity-sample")

    def count(batches):
        seen: dict[str, list[int]] = {}
        found = _Found(shared.value, None)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                for f in found.text(text):
                    seen.setdefault(f, [0, 0])[bool(y)] += 1
        yield batch_of("feature string, n0 long, n1 long", [(f, *n) for f, n in seen.items()])

    totals = {r.y: r.n for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n = totals.get(1, 0), sum(totals.values())
    if not 0 < n1 < n:
        return Model(cost, {}, np.zeros(0), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    rate = n1 / n
    counted = written(train.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).where("n1 > 1"), "toxicity-features")
    # evidence: log-likelihood gain over the base rate; it must beat what chance gives among so many features
    share = F.col("n1") / (F.col("n0") + F.col("n1"))
    gain = F.col("n1") * F.log(share / rate) + F.when(F.col("n0") > 0, F.col("n0") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    least = float(np.log(max(1, counted.count()))) + 1
    # the sample bounds their number: none has evidence in fewer than two of its toxic rows
    rows = counted.where((share > rate) & (gain > least)).select("feature").collect()
    kept = {f: i for i, f in enumerate(sorted(r.feature for r in rows))}

    def hits(batches):
        found = _Found(shared.value, kept)
        for batch in batches:
            yield batch_of("hits array<int>, y int", [(sorted(found.text(t)), y) for t, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True)])

    weights, intercept = _logistic([(r.hits, r.y) for r in train.mapInArrow(hits, "hits array<int>, y int").collect()], len(kept))
    return Model(cost, kept, weights, intercept)


def _logistic(rows: list[tuple[list[int], int]], n: int, steps: int = 400, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights of sparse 0/1 features by gradient descent with adaptive steps (Adam)."""
    rows = sorted(rows)  # the order in which tasks answer doesn't matter
    y = np.array([r[1] for r in rows], float)
    doc = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    feature = np.array([f for r in rows for f in r[0]], "i8")
    w = np.zeros(n + 1)
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = w[n] + np.bincount(doc, w[feature], len(rows))
        error = (1 / (1 + np.exp(-z)) - y) / len(rows)
        g = np.append(np.bincount(feature, error[doc], n) + ridge * w[:n], error.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w[:n], float(w[n])


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, unchanged, and its ``score`` from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        found = _Found(shared.value.cost, shared.value.kept)
        weights, base = shared.value.weights.tolist(), shared.value.intercept
        for batch in batches:
            z = np.array([base + sum(weights[f] for f in sorted(found.text(t or ""))) for t in batch.column("text").to_pylist()])
            yield batch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-z)))], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))
