"""Near duplicates of the pipeline: documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

A document of n different shingles shares one of its first n - ceil(0.8 n) + 1, in
any one order of all shingles, with every document it is linked to. The order takes
what a bounded sample of texts repeats last (it decides cost, never results), so
few shingles are met by chance. What meets is sifted by counts of shingles in
``CLASSES`` classes, which bound how far two sets differ, and verified on the whole
sets, so every link is found and no other.

Equal sets are one node. First come the links that fingerprints show: the simhashes
of the same shingles, met by the pigeonhole of ``simhash``, and the neighbours by
size of each shingle's documents. Then documents that are still in different
components and share a shingle are compared: a shingle of over ``BLOCK`` documents is
cut into blocks, every pair of blocks is a group of its own, and a group returns a
spanning forest of what its sketches let pass, one row for each document at most,
never its pairs. What a forest links is verified and joined to its component, what
fails is left out of the next round, and rounds end when no group has anything left:
so every two linked documents end in one component. Sets are made again from the
texts of candidates only. Equality of shingles and of sets is that of 64 bits of hash.

Nulls: a null text is the empty one. Rows with a null doc_id pass unchanged, but link
others. Repeated rows are one node; empty texts (and all without a word) are one node
too; texts of fewer than five words are one shingle. An empty table gives no rows.
Extra columns are carried, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, release, text_rows, tidy
from .components import roots
from .simhash import FEW, fingerprint_of, first_rows, near, shingle_hashes

#: Words of a shingle; the similarity of a link, as a fraction.
SHINGLE, PART, WHOLE = 5, 4, 5
#: Documents of a shingle in one group; texts of the sample; shingles of it that are remembered, and in how many of its texts they are.
BLOCK, SAMPLE, COMMON, OFTEN = 512, 4096, 1 << 17, 2
#: Classes of shingles that a sketch counts; differing bits of fingerprints that are worth a comparison before the exact search (cost only).
CLASSES, CLOSE = 256, 16


def shingles(text: str | None) -> np.ndarray:
    """The different shingles of a text as sorted hashes."""
    return np.unique(shingle_hashes(text, SHINGLE))


def node_of(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0])


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of each class a set has, modulo 256."""
    return np.bincount((own % np.uint64(CLASSES)).astype(np.int64), minlength=CLASSES).astype(np.uint8).tobytes()


def possible(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether sets with these sketches (rows) and sums of sizes can be linked: classes differ by no more than the sets do, which is (WHOLE - PART) / (WHOLE + PART) of the sum at most."""
    apart = (a - b).view(np.uint8)
    apart = np.minimum(apart, -apart).astype(np.int64).sum(1)
    return apart * (WHOLE + PART) <= sizes * (WHOLE - PART)


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (sorted) have a similarity of at least PART / WHOLE."""
    if min(len(a), len(b)) * WHOLE < max(len(a), len(b)) * PART:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * WHOLE >= (len(a) + len(b) - both) * PART


def _with_hash(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))


def common(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that texts of the sample share, sorted, and in how many of them each is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (texts,) in text_rows(batches, ("text",)):
            yield pa.record_batch([pa.array(np.concatenate([shingles(t) for t in texts] + [np.zeros(0, np.uint64)]).view(np.int64))], ["shingle"])

    d = _with_hash(docs)
    share = max(1, -(-docs.count() // SAMPLE))
    some = d.filter(F.pmod(F.xxhash64(F.lit(1), "text_hash"), F.lit(share)) == 0).dropDuplicates(["text_hash"]).select("text")
    rows = some.mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= OFTEN).orderBy(F.desc("count"), "shingle").limit(COMMON).collect()
    found = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    by = np.argsort(found)
    return found[by], np.array([r[1] for r in rows], np.int64)[by]


def prefix(own: np.ndarray, often: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set, of which two linked sets share one."""
    n = len(own)
    take = n - -(-n * PART // WHOLE) + 1 if n else 0
    rank = np.zeros(n, np.int64)
    if len(often):
        at = np.minimum(np.searchsorted(often, own), len(often) - 1)
        rank = np.where(often[at] == own, counts[at], 0)
    return own[np.lexsort((own, rank))[:take]]


def prints(docs: DataFrame, often: np.ndarray, counts: np.ndarray) -> DataFrame:
    """doc_id, text_hash, node, size, fp (the simhash), sketch and prefix of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, hashes, texts in text_rows(batches, ("doc_id", "text_hash", "text")):
            every = [shingle_hashes(t, SHINGLE) for t in texts]
            sets = [np.unique(h) for h in every]
            prints_ = np.array([fingerprint_of(h) for h in every], np.uint64).view(np.int64)
            first = [prefix(s, often, counts) for s in sets]
            cuts = np.cumsum([0, *map(len, first)]).astype(np.int32)
            flat = np.concatenate([*first, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch(
                [pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array([node_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(prints_), pa.array([sketch(s) for s in sets], pa.binary()), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))],
                ["doc_id", "text_hash", "node", "size", "fp", "sketch", "prefix"],
            )
        tidy()

    return _with_hash(docs).mapInArrow(run, "doc_id long, text_hash long, node long, size int, fp long, sketch binary, prefix array<long>")


def verified(spark: SparkSession, docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) that are linked: sifted by sketches, verified on the whole sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for wanted, texts in text_rows(batches, ("node", "text"), 128):
            made = [(n, s) for n, t in zip(wanted, texts, strict=True) if node_of(s := shingles(t)) == n]
            yield pa.record_batch([pa.array([n for n, _ in made], pa.int64()), pa.array([s.tobytes() for _, s in made], pa.binary())], ["node", "own"])
        tidy()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for us, vs, a, b in text_rows(batches, ("u", "v", "a", "b"), 128):
            good = [k for k in range(len(us)) if linked(np.frombuffer(a[k], np.uint64), np.frombuffer(b[k], np.uint64))]
            yield pa.record_batch([pa.array([us[k] for k in good], pa.int64()), pa.array([vs[k] for k in good], pa.int64())], ["u", "v"])
        tidy()

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CLASSES) for k in (2, 3))
            yield batch.select(["u", "v"]).filter(pa.array(possible(a, b, batch.column(4).to_numpy())))
        tidy()

    one = nodes.select(F.col("node").alias("u"), F.col("sketch").alias("a"), F.col("size").cast("long").alias("x"))
    two = nodes.select(F.col("node").alias("v"), F.col("sketch").alias("b"), F.col("size").alias("y"))
    near = pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b", (F.col("x") + F.col("y")).alias("sizes"))
    pairs = materialize(spark, near.mapInArrow(sift, "u long, v long"), "possible")
    release(spark)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "text_hash"), "node")
    wanted = materialize(spark, wanted, "wanted")
    own = materialize(spark, texts_of(docs, wanted, wanted.count() <= FEW).mapInArrow(sets, "node long, own binary"), "sets")
    left, right = own.select(F.col("node").alias("u"), F.col("own").alias("a")), own.select(F.col("node").alias("v"), F.col("own").alias("b"))
    out = materialize(spark, pairs.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(check, "u long, v long"), "links")
    discard(pairs, wanted, own)
    release(spark)
    return out


def texts_of(docs: DataFrame, wanted: DataFrame, few: bool) -> DataFrame:
    """node and text of the wanted (node, text_hash), one row each. few: they are broadcast, and no other text is shuffled (cost only)."""
    some = _with_hash(docs)
    if few:
        some = some.join(F.broadcast(wanted.select("text_hash").distinct()), "text_hash", "left_semi")
    one_each = some.groupBy("text_hash").agg(F.first("text").alias("text"))  # combined before the shuffle, however many copies there are
    return one_each.join(wanted, "text_hash").select("node", "text")


def _near() -> Column:
    return F.least("size", "other_size") * WHOLE >= F.greatest("size", "other_size") * PART


def neighbours(met: DataFrame, block: int = BLOCK) -> DataFrame:
    """u, v: documents of a shingle (of a block, where these are many) that stand next to each other, by size and by a hash that differs between shingles, and look close by their fingerprints."""
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block))
    df, found = met.withColumn("part", part), None
    by_size, by_hash = ("size", "node"), (F.xxhash64("shingle", "node"), "node")
    for order in (by_size, by_hash):
        w = W.partitionBy("shingle", "part").orderBy(*order)
        df_ = df.select("node", "size", "fp", *[F.lag(c).over(w).alias(f"other_{c}") for c in ("node", "size", "fp")])
        close = F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= CLOSE
        df_ = df_.filter(F.col("other_node").isNotNull() & (F.col("node") != F.col("other_node")) & _near() & close)
        df_ = df_.select(F.least("node", "other_node").alias("u"), F.greatest("node", "other_node").alias("v"))
        found = df_ if found is None else found.unionAll(df_)
    return found.distinct()


def by_fingerprint(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """u, v: a tree of the nodes of each fingerprint, and what the pigeonhole finds of different ones."""
    first = nodes.groupBy("fp").agg(F.min("node").alias("node"))
    same = nodes.join(first.withColumnRenamed("node", "v"), "fp").filter("node <> v").select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v"))
    found = near(spark, first.select("fp"))
    one, two = first.select(F.col("fp").alias("u"), F.col("node").alias("a")), first.select(F.col("fp").alias("v"), F.col("node").alias("b"))
    return same.unionAll(found.join(one, "u").join(two, "v").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")))


def candidates(group, node, size, comp, own, left, sketches) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows x, y of one group that may be linked, of all groups (sorted) at once: of different components, and allowed by sizes and sketches.

    own, left: a row's block and its group's first one; rows of one block meet in the group of that block with itself.
    One distance of rows at a time, so no more pairs than rows are held.
    """
    cuts = np.flatnonzero(np.diff(group)) + 1
    ends = np.repeat([*cuts, len(group)], np.diff([0, *cuts, len(group)]))
    x, step = np.arange(len(group)), 1
    while len(x := x[x + step < ends[x]]):  # each row with the one so many rows after it
        y = x + step
        good = (comp[x] != comp[y]) & ((own[x] != own[y]) | (own[x] == left[x])) & (np.minimum(size[x], size[y]) * WHOLE >= np.maximum(size[x], size[y]) * PART)
        a, b = x[good], y[good]
        fits = [possible(sketches[a[k : k + 4096]], sketches[b[k : k + 4096]], size[a[k : k + 4096]] + size[b[k : k + 4096]]) for k in range(0, len(a), 4096)]
        if fits:
            fits = np.concatenate(fits)
            yield a[fits], b[fits]
        step += 1


def forest(pairs, group, node, comp, failed, depth: int = 1) -> tuple[list[int], list[int]]:
    """The candidates that connect components of their group that none before them connects; failed pairs connect nothing.

    depth: so many forests, each of what those before it leave: a document is in that many pairs, on the average, at most twice.
    A pair goes to the first forest that it connects anything in, or nowhere, as soon as it is met.
    """

    def top(root, k):
        while (above := root.get(k, k)) != k:
            root[k] = k = root.get(above, above)  # from left to right
        return k

    roots_: list[dict[tuple[int, int], tuple[int, int]]] = [{} for _ in range(depth)]
    out: tuple[list[int], list[int]] = ([], [])
    for x, y in pairs:
        for a, b in zip(x.tolist(), y.tolist(), strict=True):
            if failed and (min(node[a], node[b]), max(node[a], node[b])) in failed:
                continue
            g = int(group[a])
            for root in roots_:
                u, v = top(root, (g, int(comp[a]))), top(root, (g, int(comp[b])))
                if u != v:
                    root[u] = v
                    out[0].append(a), out[1].append(b)
                    break
    return out


#: Rows that are compared at once (a group's rows stay together); forests of a group that has had failures.
ROWS, DEPTH = 1 << 14, 16


def tried(node: np.ndarray, lists: pa.ChunkedArray) -> set[tuple[int, int]]:
    """Failed pairs among the nodes of these rows. lists: those a row's node failed with, the same in all of its rows, most of them not here."""
    own, first = np.unique(node, return_index=True)
    lists = lists.take(pa.array(first))
    one, other = np.repeat(own, pc.fill_null(pc.list_value_length(lists), 0).to_numpy()), pc.list_flatten(lists).to_numpy()
    here = np.isin(other, own)
    return set(zip(np.minimum(one, other)[here].tolist(), np.maximum(one, other)[here].tolist(), strict=True))


def _pairs(batches: Iterator[pa.RecordBatch], depth: int = DEPTH) -> Iterator[pa.RecordBatch]:
    """u, v, shingle of the forests of all groups (shingle, i, j; sorted); a group's rows may span batches. depth: of those with failures."""

    def made(t: pa.Table) -> pa.RecordBatch:
        shingle, i, j, node, size, comp, own = (t.column(c).to_numpy().astype(np.int64) for c in ("shingle", "i", "j", "node", "size", "comp", "own"))
        group = np.cumsum(np.concatenate([[0], (np.diff(shingle) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]))
        sketches = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(-1, CLASSES)
        lists = t.column("failed")
        failed = tried(node, lists) if lists.null_count < len(lists) else set()
        x, y = (np.array(k, np.int64) for k in forest(candidates(group, node, size, comp, own, i, sketches), group, node, comp, failed, depth if failed else 1))
        a, b = node[x], node[y]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(shingle[x])], ["u", "v", "shingle"])

    held: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        held = t if held is None else pa.concat_tables([held, t])
        while held.num_rows > ROWS:
            last = [held.column(c)[-1].as_py() for c in ("shingle", "i", "j")]
            same = np.ones(held.num_rows, bool)  # the last group may go on in the next batch
            for c, value in zip(("shingle", "i", "j"), last, strict=True):
                same &= held.column(c).to_numpy() == value
            n = int(np.flatnonzero(same)[0])
            if not n:
                break
            yield made(held.slice(0, n).combine_chunks())
            held = held.slice(n).combine_chunks()
    if held is not None and held.num_rows:
        yield made(held.combine_chunks())
    tidy()


def others(met: DataFrame, nodes: DataFrame, failed: DataFrame, block: int = BLOCK, depth: int = DEPTH) -> DataFrame:
    """u, v, shingle: for each shingle's documents in different components (met: shingle, node, size, n, comp), a forest of the pairs that may be linked. failed: u, v of pairs that are not."""
    mixed = met.groupBy("shingle").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).filter("a < b").select("shingle")
    not_with = failed.groupBy(F.col("u").alias("node")).agg(F.collect_list("v").alias("failed"))
    own = nodes.select("node", "sketch").join(not_with, "node", "left")
    df = met.join(mixed, "shingle").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    df = df.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(own, "node")
    df = df.select("shingle", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "node", "size", "comp", "own", "sketch", "failed")
    return df.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j", "node").mapInArrow(lambda batches: _pairs(batches, depth), "u long, v long, shingle long")


def components(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the least id of its component) of every row."""
    rows = materialize(spark, prints(docs, *common(docs)), "shingle-prints")
    per = rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("text_hash").alias("text_hash"), F.min("fp").alias("fp"), *[F.first(c).alias(c) for c in ("size", "sketch", "prefix")])
    nodes = materialize(spark, per, "nodes")
    release(spark)
    dealt = nodes.select("node", "size", "fp", F.explode("prefix").alias("shingle"))
    met = materialize(spark, dealt.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("shingle"))).filter("n > 1"), "met")
    release(spark)
    first = neighbours(met).unionAll(by_fingerprint(spark, nodes)).distinct()
    edges = verified(spark, docs, nodes, materialize(spark, first, "neighbours"))
    root, failed, depth = roots(spark, edges), edges.limit(0), DEPTH
    while True:
        placed = met.join(root, "node", "left").select("shingle", "node", "size", "n", F.coalesce("root", "node").alias("comp"))
        asked = materialize(spark, others(placed, nodes, failed, depth=depth), "others")
        release(spark)
        pairs = asked.select("u", "v").distinct()
        if not pairs.limit(1).count():
            break
        good = verified(spark, docs, nodes, pairs)
        bad = materialize(spark, pairs.join(good, ["u", "v"], "left_anti"), "failed")
        if good.limit(1).count():
            root = roots(spark, root.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(good))
        # where every pair of a shingle's forest is a link, its documents have nothing left to compare
        if not bad.limit(1).count():
            break
        # what fails is often one large group of long texts: twice the forests each time, so rounds are few
        depth *= 1 if failed.limit(1).count() == 0 else 2
        failed, last = failed.unionAll(bad), met
        met = materialize(spark, met.join(asked.join(bad, ["u", "v"], "left_semi").select("shingle").distinct(), "shingle", "left_semi"), "met")
        discard(last, asked, good)
    placed = nodes.join(root, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return rows.select("doc_id", "node").join(placed.join(ids, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows whose doc_id is their component's least, one for each doc_id, and those without a doc_id; columns as they were."""
    return first_rows(spark, docs, components(spark, docs))
