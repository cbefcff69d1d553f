"""Near-duplicate documents by tensored MinHash banding.

Two small collections of minhash tuples are computed for each document. A table key is a pair of one tuple of either
collection, so ``2 * tuples`` tuples serve ``tuples ** 2`` tables: minhash work falls to about its square root. A pair
of documents shares a table if it agrees in one tuple of each collection at least; at similarity s it misses all of
them with a probability of at most 2 * (1 - s ** 2) ** tuples, 5.4e-6 for s = 0.85 and ten tuples of two.

1. Sign: one pass makes shingle-set hashes and tuples. Documents of equal sets become one node, named by a digest of
   16 bytes of its set. Words are hashed by a cryptographic digest, so no text of a special form makes words collide.
2. Tuples that only one node has can't meet another: nodes without a shared tuple in both collections drop out.
3. Each table has a leader; the nodes that share a table with a leader are its group. Members of large groups are
   compared with the leader first, and those that are linked with it need no comparison among each other.
4. What is left of a group is compared in blocks of bounded size (nodes and shingles), on full sets; a block gives the links that join
   components, not its pairs. Linked sets are alike in size, so a large group is parted by classes of size, and blocks
   meet within a class and with the next one only. No link between different texts is lost, and no group is in one task.

Null and empty texts, and texts without words, have no set and no links. Repeated rows have equal sets. Very long texts
have large sets, which are compared whole; blocks are bounded by their shingles. Empty tables give no rows. Ties: of
equal ranks the lesser node leads. Only doc_id and text are read, so no other column can clash.
"""

from __future__ import annotations

from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.common import batch_from, batch_of, id_and_text, row_key, sliced, written
from tideline.llm.hashing import WordHashes, mix

#: Minhashes of a tuple; tuples of either collection; nodes of a block, and their shingles in sum.
WIDTH, TUPLES, BLOCK, SHINGLES = 2, 10, 256, 1 << 19
_SIGNED = "key binary, doc_id long, n_shingles long, node binary, a array<long>, b array<long>"
_WORDS = WordHashes()


def shingles(text: str, width: int) -> np.ndarray:
    """The sorted hashes of a text's distinct shingles; with fewer words, of the whole sequence."""
    found = text.encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z alone, and white space of ASCII
    if not found:
        return np.zeros(0, "u8")
    words = np.frombuffer(b"".join(map(_WORDS.__getitem__, found)), "<u8")
    width = min(width, len(words))
    out = np.zeros(len(words) - width + 1, "u8")
    for k in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + len(out)]
    return np.unique(mix(out + np.uint64(width)))


@cache
def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 1 << 63, (n, 1), dtype="u8") * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, (n, 1), dtype="u8")


def tuples(found: np.ndarray, n: int) -> np.ndarray:
    """2 * n tuple hashes: the first n are one collection's, the others the other's."""
    a, b = _functions(2 * n * WIDTH)
    least = np.full(2 * n * WIDTH, np.iinfo("u8").max)
    for at in range(0, len(found), 4096):
        x = found[at : at + 4096] * a + b
        least = np.minimum(least, (x ^ x >> np.uint64(32)).min(1))
    least = least.reshape(2 * n, WIDTH)
    out = np.arange(2 * n, dtype="u8")
    for k in range(WIDTH):
        out = mix(out * np.uint64(0xD1342543DE82EF95) + least[:, k])
    return out


def _sign(width: int, n: int):
    def run(batches):
        for batch in sliced(batches, 1000):
            rows = []
            for key, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                found = shingles(text, width)
                if len(found):
                    t = tuples(found, n).view("i8").tolist()
                    rows.append((key, doc_id, len(found), blake2b(found.tobytes(), digest_size=16).digest(), t[:n], t[n:]))
                else:
                    rows.append((key, doc_id, 0, None, None, None))
            yield batch_of(_SIGNED, rows)

    return run


def _sets(width: int):
    def run(batches):
        for batch in sliced(batches, 1000):
            yield batch_from("node binary, found binary", node=batch.column("node"), found=[shingles(t, width).tobytes() for t in batch.column("text").to_pylist()])

    return run


def _similar(percent: int):
    def run(batches):
        for batch in batches:
            keep, first, second = [], batch.column("x"), batch.column("y")
            for i in range(batch.num_rows):  # the sets stay in Arrow's memory
                x, y = np.frombuffer(first[i].as_buffer(), "u8"), np.frombuffer(second[i].as_buffer(), "u8")
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(keep, pa.bool_())], names=["u", "v", "linked"])

    return run


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v, linked`` of pairs of nodes, on their full sets."""
    x, y = sets.select(F.col("node").alias("u"), F.col("found").alias("x")), sets.select(F.col("node").alias("v"), F.col("found").alias("y"))
    return pairs.select("u", "v").join(x.hint("merge"), "u").join(y.hint("merge"), "v").mapInArrow(_similar(percent), "u binary, v binary, linked boolean")


def _blocks(percent: int):
    """Links between components within a block, or between two: a spanning forest of them."""

    def run(table: pa.Table) -> pa.Table:
        node, part, side = table.column("node").to_pylist(), np.unique(table.column("component").to_pylist(), return_inverse=True)[1], np.asarray(table.column("side"))
        sets = [np.frombuffer(x.as_buffer(), "u8") for x in table.column("found")]
        size = np.array([*map(len, sets)])
        shingle, where = np.unique(np.concatenate(sets), return_inverse=True)
        owner = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(where, kind="stable")
        where, owner = where[order], owner[order]
        common = np.zeros((len(sets), len(sets)), "f4")
        for at in range(0, len(shingle), 8192):
            a, b = np.searchsorted(where, (at, at + 8192))
            has = np.zeros((len(sets), min(8192, len(shingle) - at)), "f4")
            has[owner[a:b], where[a:b] - at] = 1
            common += has @ has.T
        union = size[:, None] + size[None, :] - common
        linked = (100 * common >= percent * union) & (part[:, None] != part[None, :])
        if side.min() != side.max():
            linked &= side[:, None] != side[None, :]
        above: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := above.get(x, x)) != x:
                above[x] = x = above.get(y, y)
            return x

        out = []
        for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
            a, b = top(int(part[i])), top(int(part[j]))
            if a != b:
                above[a] = b
                out.append((node[i], node[j]))
        return pa.Table.from_batches([batch_of("u binary, v binary", out)])

    return run


def compared(groups: DataFrame, counts: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``u, v``: links that join components (``found``; else a node is its own) within groups.

    A small group is one block. Of a large one, nodes in the leader's component (side 1) are compared with the others
    (side 0) only, and these among themselves: a block of side 0 meets those of both sides whose class of size is its
    own or next to it (a class spans the factor that two linked sets can differ by).
    """
    of = found.select(F.col("node").alias("leader"), F.col("component").alias("leaders"))
    # what a leader's members are joined to is a table of its own, so Spark can split the members of a hot leader
    heads = written(counts.where("n > 1").join(of, "leader", "left").select("leader", F.coalesce("leaders", "leader").alias("leaders"), "n"), "heads")
    placed = groups.join(found, "node", "left").join(heads, "leader").select("leader", "node", "size", F.coalesce("component", "node").alias("component"), "leaders", "n")
    large = F.col("n") > BLOCK
    klass = F.when(large, F.floor(F.ln("size") / (np.log(100 / percent) * (1 + 1e-9)))).otherwise(0).cast("int")
    placed = written(placed.withColumns({"side": F.when(large & (F.col("component") == F.col("leaders")), 1).otherwise(0), "klass": klass}), "placed")
    own = lambda s, x: F.sum(F.when(F.col("side") == s, x).otherwise(0))
    sizes = placed.groupBy("leader", "klass").agg(*(F.ceil(F.greatest(own(s, F.lit(1)) / BLOCK, own(s, F.col("size")) / SHINGLES)).cast("int").alias(f"blocks{s}") for s in (0, 1)))
    sizes = written(sizes, "sizes")
    beside = sizes.select("leader", F.explode(F.array(*(F.col("klass") + d for d in (-1, 0, 1)))).alias("klass"), F.struct(F.col("klass").alias("k"), "blocks0", "blocks1").alias("s"))
    around = written(beside.groupBy("leader", "klass").agg(F.collect_list("s").alias("around")).join(sizes, ["leader", "klass"]), "around")  # three classes at most
    unit = lambda k, b: (k.cast("long") + 1) * F.lit(1 << 32) + b
    blocks = F.when(F.col("side") == 1, F.col("blocks1")).otherwise(F.col("blocks0"))
    dealt = placed.join(around, ["leader", "klass"]).withColumn("own", unit(F.col("klass"), F.pmod(F.xxhash64("node"), blocks)))
    units = lambda side: F.flatten(F.transform("around", lambda a: F.when(a[f"blocks{side}"] > 0, F.transform(F.sequence(F.lit(0), a[f"blocks{side}"] - 1), lambda b: unit(a["k"], b))).otherwise(F.array().cast("array<bigint>"))))
    with_zero = F.transform(units(0), lambda u: F.struct(F.least(u, "own").alias("i"), F.greatest(u, "own").alias("j"), F.lit(0).alias("other")))
    with_one = F.transform(units(1), lambda u: F.struct(F.col("own").alias("i"), u.alias("j"), F.lit(1).alias("other")))
    zero_meets = F.transform(units(0), lambda u: F.struct(u.alias("i"), F.col("own").alias("j"), F.lit(1).alias("other")))
    meets = dealt.select("leader", "node", "component", "side", F.explode(F.when(F.col("side") == 1, zero_meets).otherwise(F.concat(with_zero, with_one))).alias("m")).select("leader", "m.*", "node", "component", "side")
    return meets.join(sets.hint("merge"), "node").groupBy("leader", "i", "j", "other").applyInArrow(_blocks(percent), "u binary, v binary")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of the nodes of undirected edges ``u, v``."""
    both = written(edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        over = labels.select(F.col("node").alias("component"), F.col("component").alias("over"))
        after = labels.join(near, "node").join(over, "component").select("node", F.least("component", "m", "over").alias("component"), (F.least("m", "over") < F.col("component")).alias("moved"))
        after = written(after, "labels")
        labels = after.select("node", "component")
        if not after.where("moved").limit(1).count():
            return labels


def _linked(docs: DataFrame, width: int, percent: int, n: int) -> DataFrame:
    """``key, doc_id, n_shingles, component, component_id`` of every row; ``component`` (a node) is null without words."""
    keyed = row_key(id_and_text(docs))
    signed = written(keyed.mapInArrow(_sign(width, n), _SIGNED), "signed")
    nodes = written(
        signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("key").alias("key"), F.first("n_shingles").alias("size"), F.first("a").alias("a"), F.first("b").alias("b")), "nodes"
    )
    tuple_rows = nodes.select("node", "size", "key", F.explode(F.concat(F.transform("a", lambda t: F.struct(t.alias("t"), F.lit(True).alias("first"))), F.transform("b", lambda t: F.struct(t.alias("t"), F.lit(False).alias("first"))))).alias("s")).select("node", "size", "key", "s.*")
    shared = tuple_rows.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    met = tuple_rows.join(shared, "t").groupBy("node").agg(F.first("size").alias("size"), F.first("key").alias("key"), F.collect_list(F.when(F.col("first"), F.col("t"))).alias("a"), F.collect_list(F.when(~F.col("first"), F.col("t"))).alias("b"))
    met = written(met.where("size(a) > 0 and size(b) > 0"), "met")
    tables = met.select("node", "size", "b", F.explode("a").alias("x")).select("node", "size", F.explode(F.transform("b", lambda y: F.xxhash64("x", y))).alias("bucket"))
    leaders = tables.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct(F.xxhash64("node").alias("rank"), "node")).alias("leader")).where("n > 1")
    tables = tables.join(leaders, "bucket").select("node", "size", F.col("leader.node").alias("leader"))

    groups = written(tables.select("leader", "node", "size").distinct(), "groups")

    wanted = groups.select("node").distinct().join(met.select("node", "key"), "node")
    texts = keyed.join(wanted.select("key").hint("merge"), "key", "left_semi").dropDuplicates(["key"]).select("key", "text")
    sets = written(texts.join(wanted.hint("merge"), "key").select("node", "text").mapInArrow(_sets(width), "node binary, found binary"), "sets")
    counts = written(groups.groupBy("leader").agg(F.count("*").alias("n")), "counts")
    large = groups.join(counts.where(F.col("n") > BLOCK), "leader").where("node != leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    stars = written(confirm(large, sets, percent).where("linked").select("u", "v"), "stars")
    found = components(stars)
    links = written(stars.unionAll(compared(groups, counts, found, sets, percent)), "links")
    found = components(links)

    least = nodes.join(found, "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    linked = found.join(least, "component").select("node", "component", "component_id")
    ids = nodes.select("node", "first_id").join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"), F.coalesce("component_id", "first_id").alias("component_id"))
    out = signed.select("key", "doc_id", "n_shingles", "node").join(ids, "node", "left").withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("key", "doc_id", "n_shingles", "component", "component_id")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, n: int = TUPLES) -> DataFrame:
    """``key, doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Documents are linked if 100 * intersection >= ``percent`` * union of their sets of ``width``-word shingles.
    ``component_id`` is the smallest id that links reach (null if no row there has an id), ``key`` that of ``row_key``.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return _linked(docs, width, percent, n).select("key", "doc_id", "n_shingles", "component_id", kept)


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80, n: int = TUPLES) -> DataFrame:
    """``key`` of one document of each linked group, that of the least id (null last) and key, and of all without words.

    Ids may be null or come again: groups are told apart by what is linked.
    """
    rows = _linked(docs, width, percent, n)
    first = rows.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("least"))
    return first.select("least.key").unionAll(rows.where("component is null").select("key")).distinct()
