"""Plain versions of two stages, for the pipeline's test."""

import re
from collections import Counter

import numpy as np


def near_kept(texts, width, percent):
    """The ids of the smallest document of each linked group."""
    sets, where, above = {}, {}, {i: i for i in texts}

    def top(x):
        while above[x] != x:
            x = above[x]
        return x

    for i in sorted(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), texts[i] or ""))
        k = min(width, len(words))
        sets[i] = {tuple(words[a : a + k]) for a in range(len(words) - k + 1)} if words else set()
        for j, n in Counter(j for x in sets[i] for j in where.get(x, ())).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                above[b] = a
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    return {i for i in texts if top(i) == i}


def without_passages(texts, length, words=0):
    """The bytes that no repeated string of this length covers, or that stand in covered runs of so many words at most."""
    data = {i: (t or "").encode() for i, t in texts.items()}
    seen = Counter(hash(d[p : p + length]) for d in data.values() for p in range(len(d) - length + 1))
    out = {}
    for i, d in data.items():
        gone = np.zeros(len(d), bool)
        for p in range(len(d) - length + 1):
            if seen[hash(d[p : p + length])] > 1:
                gone[p : p + length] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if words and len(d[a:b].split()) <= words:
                gone[a:b] = False
        out[i] = np.frombuffer(d, "u1")[~gone].tobytes() if d else b""
    return out
