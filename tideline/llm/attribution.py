"""Token counts by section or field: offset-mapped attribution.

A whole document is encoded once. Byte-level tokens tile the text, so their byte spans follow from their lengths; the
spans are joined to the sections' spans by position, where both are: a document's spans never leave its task. A token
that crosses a boundary is allocated by a rule:

* ``majority``: to the section that holds most of its bytes, the earlier one of equals;
* ``start``: to the section that holds its first byte.

So every token counts once. Null and empty texts have one empty section, null fields are empty. Repeated rows give
repeated rows, empty tables none. Columns other than the id and those asked for are not read. A very long text goes to
the tokenizer in parts, cut where tokens always part.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch_from, id_and_text

RULES = ("majority", "start")
_OUT = "doc_id long, section long, kind string, first long, last long, n_tokens long, n_crossing long"

#: Characters from which on a text is cut at the next single space, which bounds the memory of one encoding.
PART = 500_000
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def _tokenizer(path: str):
    """The tokenizer of a file and the byte length of each id's token."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    tok.encode_special_tokens = True  # the names of special tokens are ordinary text here
    vocabulary = tok.get_vocab(with_added_tokens=True)
    sizes = np.zeros(max(vocabulary.values()) + 1, "i8")
    sizes[[*vocabulary.values()]] = [*map(len, vocabulary)]  # a letter stands for a byte
    return tok, sizes


def parts(text: str) -> Iterator[str]:
    """A text in parts of about PART characters: the pre-tokenizer always parts a single space from what stands before it."""
    at = 0
    while len(text) - at > PART and (cut := _CUT.search(text, at + PART)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def token_lengths(path: str, text: str) -> np.ndarray:
    """Byte lengths of the tokens of a whole text."""
    tok, sizes = _tokenizer(path)
    return np.concatenate([sizes[np.array(tok.encode(x, add_special_tokens=False).ids, "i8")] for x in parts(text)])


def lead_and_lines(text: str) -> list[tuple[str, int, int]]:
    """Sections of a text as byte spans that tile it: its first sentence, the rest of that line, each later line."""
    data = text.encode("utf-8", "surrogatepass")
    ends = [m.end() for m in re.finditer(b"\n", data)]
    if not ends or ends[-1] < len(data):
        ends.append(len(data))
    stop = re.search(rb"[.!?] ", data[: ends[0]])
    spans = [("lead", 0, stop.end() if stop else ends[0])]
    if stop and stop.end() < ends[0]:
        spans.append(("line", stop.end(), ends[0]))
    return spans + [("line", a, b) for a, b in zip(ends, ends[1:], strict=False)]


def allocate(lengths: np.ndarray, first: np.ndarray, last: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those among them that cross a boundary; sections are sorted and don't overlap.

    Tokens outside all sections count nowhere.
    """
    end = np.cumsum(lengths, dtype="i8")
    start = end - lengths
    at = np.searchsorted(first, start, side="right") - 1  # the section that begins at or before the token
    inside = (at >= 0) & (end <= last[np.maximum(at, 0)])
    count = np.bincount(at[inside], minlength=len(first))
    crossing = np.zeros(len(first), "i8")
    for t in np.flatnonzero(~inside).tolist():
        a, b, best, most = int(start[t]), int(end[t]), -1, 0
        for s in range(max(0, int(at[t])), len(first)):
            if first[s] >= b:
                break
            shared = min(b, int(last[s])) - max(a, int(first[s]))
            if rule == "start":
                shared = int(first[s] <= a < last[s])
            if shared > most:
                best, most = s, shared
        if best >= 0:
            count[best] += 1
            crossing[best] += 1
    return count, crossing


def _attributed(texts: DataFrame, path: str, rule: str, sections: Callable) -> DataFrame:
    """``texts``: doc_id, text, and what ``sections`` takes beside the text."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches):
        for batch in batches:
            ids, kinds, numbers, spans, counts = [], [], [], [], []
            for doc_id, text, *given in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sections(text, *given)
                first, last = np.array([s[1] for s in own], "i8"), np.array([s[2] for s in own], "i8")
                ids += [doc_id] * len(own)
                kinds += [s[0] for s in own]
                numbers.append(np.arange(len(own)))
                spans.append((first, last))
                counts.append(allocate(token_lengths(path, text), first, last, rule))
            if ids:
                (first, last), (n, crossing) = (map(np.concatenate, zip(*x, strict=True)) for x in (spans, counts))
                yield batch_from(_OUT, doc_id=ids, section=np.concatenate(numbers), kind=kinds, first=first, last=last, n_tokens=n, n_crossing=crossing)

    return texts.mapInArrow(run, _OUT)


def token_counts(docs: DataFrame, path: str, rule: str = "majority", sections: Callable = lead_and_lines) -> DataFrame:
    """A row for each section of each document: its kind, byte span, tokens, and those that cross its boundaries."""
    return _attributed(id_and_text(docs), path, rule, sections)


def field_counts(rows: DataFrame, path: str, fields: Sequence[str], rule: str = "majority", between: str = "\n") -> DataFrame:
    """The same for columns: a row's ``fields`` are joined by ``between``, encoded as one text, and counted by field.

    What stands between two fields belongs to the earlier one, so the fields' tokens are those of the whole text.
    """
    if not fields:
        raise ValueError("no fields")
    own = [F.coalesce(F.col("`" + f.replace("`", "``") + "`").cast("string"), F.lit("")) for f in fields]
    closed = [F.concat(c, F.lit(between)) for c in own[:-1]] + own[-1:]
    texts = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.concat(*closed).alias("text"), F.array(*map(F.octet_length, closed)).alias("sizes"))

    def sections(text: str, sizes: list[int]) -> list[tuple[str, int, int]]:
        ends = np.cumsum(sizes).tolist()
        return [*zip(fields, [0, *ends[:-1]], ends, strict=True)]

    return _attributed(texts, path, rule, sections)
