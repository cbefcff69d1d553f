"""Quality classifier: a linear-chain conditional random field over a document's lines.

Every line has features of its own and those of the lines beside it; the chain labels it good or bad. The marginal
probabilities of forward-backward, weighted by the lines' lengths, make the document's share of bad text, and a
logistic curve learned with them turns that share and its square root into the score.

The field is learned from a bounded sample of labelled rows (SAMPLE); in training a line has its document's label.
Null and empty texts are one empty line. Repeated rows get equal scores; a very long text is one long chain, read whole.
Ties between a label's two values keep the higher one. Empty tables give no rows; without labels every score is one half. Clashing columns: as in ``toxicity``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tideline.llm.toxicity import labelled_sample

#: Labelled documents that the field is learned from at most.
SAMPLE = 4_000
OWN = ("bias", "log_words", "word_length", "capitals", "symbols", "exclamations", "digits", "distinct", "ends", "starts", "repeated_line", "short", "beyond_ascii", "empty")
_CAPITALS, _SMALL, _DIGITS, _HIGH = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58)), bytes(range(128, 256))


def _n(data: bytes, of: bytes) -> int:
    return len(data) - len(data.translate(None, of))


def line_features(text: str) -> tuple[list[tuple[float, ...]], list[int]]:
    """OWN features of each line, and the lines' lengths in bytes."""
    rows, lengths, seen = [], [], set()
    for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        n, size = len(words), len(line)
        capitals, small, high = _n(line, _CAPITALS), _n(line, _SMALL), _n(line, _HIGH)
        some, chars = max(n, 1), max(size, 1)
        rows.append((
            1.0, np.log1p(n) / 5, min(size / some, 30) / 10, capitals / max(capitals + small, 1), min(_n(line, b"#*$%&|<>") / some, 3), min(line.count(b"!") / some, 3),
            _n(line, _DIGITS) / chars, len(set(words)) / some, float(line[-1:] in (b".", b"!", b"?")), float(line[:1].isupper()), float(line in seen and n > 0), float(n < 4), high / chars, float(n == 0),
        ))
        lengths.append(size + 1)
        seen.add(line)
    return rows, lengths


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line features with those of both neighbours, line lengths, and where each document's lines begin."""
    parts = [line_features(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(p[1]) for p in parts])]).astype("i8")
    own = np.array([r for p in parts for r in p[0]], float).reshape(-1, len(OWN))
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[starts[:-1]] = 0
    after[starts[1:] - 1] = 0
    return np.hstack([own, before, after]), np.array([x for p in parts for x in p[1]], float), starts


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(bad: np.ndarray, starts: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of "bad", sums of the pair marginals, and the log partition, all chains in step.

    ``bad`` are the lines' scores for bad (those for good are 0), ``move`` the 2 x 2 scores of two adjacent labels.
    """
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = starts[:-1][order], sizes[order]
    scores = np.stack([np.zeros_like(bad), bad], 1)
    alpha, beta = scores.copy(), np.zeros_like(scores)
    longest = int(sizes[0]) if len(sizes) else 0
    live = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    for t in range(1, longest):
        at = begin[: live[t]] + t
        a = alpha[at - 1]
        alpha[at, 0] += _add(a[:, 0] + move[0, 0], a[:, 1] + move[1, 0])
        alpha[at, 1] += _add(a[:, 0] + move[0, 1], a[:, 1] + move[1, 1])
    for t in range(longest - 1, 0, -1):
        at = begin[: live[t]] + t
        b = beta[at] + scores[at]
        beta[at - 1, 0] = _add(b[:, 0] + move[0, 0], b[:, 1] + move[0, 1])
        beta[at - 1, 1] = _add(b[:, 0] + move[1, 0], b[:, 1] + move[1, 1])
    last = begin + sizes - 1
    whole = _add(alpha[last, 0], alpha[last, 1])
    total = np.empty(len(sizes))
    total[order] = whole
    of = np.repeat(total, np.diff(starts))
    marginal = np.exp(alpha[:, 1] + beta[:, 1] - of)
    inner = np.ones(len(bad), bool)
    inner[starts[:-1]] = False
    at = np.flatnonzero(inner)
    pairs = np.array([[np.exp(alpha[at - 1, i] + move[i, j] + scores[at, j] + beta[at, j] - of[at]).sum() for j in (0, 1)] for i in (0, 1)])
    return marginal, pairs, float(whole.sum())


@dataclass
class Model:
    """Weights of the line features, scores of adjacent labels, and the curve from shares to the score."""

    weights: np.ndarray
    move: np.ndarray
    curve: np.ndarray


def _shares(marginal: np.ndarray, lengths: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document: 1, its length-weighted share of bad text, and the square root of that share."""
    share = np.add.reduceat(marginal * lengths, starts[:-1]) / np.add.reduceat(lengths, starts[:-1])
    return np.stack([np.ones_like(share), share, np.sqrt(share)], 1)


def train(texts: list[str], y: list[int], steps: int = 200) -> Model:
    """Maximum likelihood by gradient ascent with adaptive steps (Adam); ``y`` is 1 for good documents."""
    x, lengths, starts = features(texts)
    bad_docs = 1.0 - np.array(y, float)
    bad = np.repeat(bad_docs, np.diff(starts))
    inner = np.ones(len(bad), bool)
    inner[starts[:-1]] = False
    same = bad[inner]
    seen = np.array([[(1 - same).sum(), 0], [0, same.sum()]])
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        marginal, pairs, _ = forward_backward(x @ theta[:-4], starts, theta[-4:].reshape(2, 2))
        g = np.append(x.T @ (bad - marginal), (seen - pairs).reshape(-1)) / len(bad) - 1e-4 * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta += 0.1 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    weights, move = theta[:-4], theta[-4:].reshape(2, 2)
    z = _shares(forward_backward(x @ weights, starts, move)[0], lengths, starts)
    curve = np.zeros(z.shape[1])
    for _ in range(50):  # Newton's method with a small ridge
        p = 1 / (1 + np.exp(-z @ curve))
        h = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(curve))
        curve += np.linalg.solve(h, z.T @ (1 - bad_docs - p) - 1e-2 * curve)
    return Model(weights, move, curve)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from at most ``sample`` labelled documents."""
    rows = sorted((r.text, r.y) for r in labelled_sample(docs, labels, label, sample).collect())
    if not rows:
        return Model(np.zeros(3 * len(OWN)), np.zeros((2, 2)), np.zeros(3))
    return train([r[0] for r in rows], [r[1] for r in rows])


def document_scores(texts: list[str], model: Model) -> np.ndarray:
    x, lengths, starts = features(texts)
    marginal, _, _ = forward_backward(x @ model.weights, starts, model.move)
    return 1 / (1 + np.exp(-_shares(marginal, lengths, starts) @ model.curve))


def line_labels(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, line, bad``: the marginal probability that a line is bad."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, _, starts = features([t or "" for t in batch.column("text").to_pylist()])
                marginal, _, _ = forward_backward(x @ shared.value.weights, starts, shared.value.move)
                ids = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                line = np.arange(len(marginal)) - starts[:-1][ids]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), pa.array(line), pa.array(marginal)], names=["doc_id", "line", "bad"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, line long, bad double")


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, unchanged, and its ``score`` from 0 (bad) to 1 (good)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):  # lines of many documents at once take much memory
                part = batch.slice(at, 1000)
                scores = document_scores([t or "" for t in part.column("text").to_pylist()], shared.value)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(scores)], names=[*keep, "score"])

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, docs.select(*keep).schema.add("score", "double"))
