"""SimHash near duplicates by a generalised pigeonhole (operator 4).

A fingerprint has a bit for each bit that over half of a text's shingle hashes
set. Two fingerprints are linked at ``RADIUS`` or fewer differing bits.

Bits are split into parts, correlated bits into the same one (from the
co-occurrence of bits over all distinct fingerprints). If parts have thresholds
t_i >= -1 with sum RADIUS - parts + 1, two linked fingerprints are within t_i in
some part i. Every distinct fingerprint gets thresholds of its own: a dynamic
program over the parts takes the least sum of probes and expected candidates,
estimated from a bounded sample of fingerprints (it decides cost, never results).
All fingerprints are stored under their values of all parts; each probes the
values within its thresholds, and what meets is verified on all 64 bits.

Equal texts and equal fingerprints are one node. A bucket of over ``BLOCK`` rows is
cut into blocks and every pair of blocks is a group of its own, so no task holds
an unbounded group; a group returns the edges of a spanning forest of its links,
at most one per row, never all pairs. Components are found without the driver.

Nulls: a null text has no words, like the empty one: fingerprint zero, linked like
any other. A row with a null doc_id gets its component's least id, which is null
if no row there has one. Repeated rows give equal rows; extra columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, text_rows
from .components import roots

BITS, SHINGLE, SEED, RADIUS = 64, 3, 42, 3
#: Rows of a bucket that are compared in one group; fingerprints on which candidates are estimated; a probe's cost in comparisons.
BLOCK, SAMPLE, PROBE_COST = 1024, 1024, 100.0
#: Ids that are broadcast, at most (cost only).
FEW = 1 << 18
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of a text's shingles in order, none without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
    starts, ends = [0, *(spaces + 1).tolist()], [*spaces.tolist(), len(flat)]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts[:n], ends[-n:], strict=True)], np.uint64)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bits that over half of the hashes set; 0 without any."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 16):
        total += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in text_rows(batches, ("doc_id", "text")):
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _co_occurrence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((BITS, BITS), np.int64)
    for batch in batches:
        bits = np.unpackbits(batch.column(0).to_numpy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
        total += (bits.T @ bits).astype(np.int64)
    i, j = np.triu_indices(BITS)
    yield pa.record_batch([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "n"])


def correlations(nodes: DataFrame, count: int) -> np.ndarray:
    """Absolute correlation of each pair of bits over all distinct fingerprints."""
    rows = nodes.select("fp").mapInArrow(_co_occurrence, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()  # 2,080 rows
    both = np.zeros((BITS, BITS))
    for i, j, n in rows:
        both[i, j] = both[j, i] = n / max(1, count)
    p = np.diag(both)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(both - np.outer(p, p)) / np.outer(sd, sd)


def count_parts(count: int, radius: int = RADIUS) -> int:
    """Parts for so many fingerprints: the number with the least probes and expected candidates."""

    def cost(m: int) -> float:
        size, spare = BITS / m, radius - m + 1
        tau = [spare // m + (k < spare % m) for k in range(m)]
        probes = [sum(comb(int(size), x) for x in range(t + 1)) for t in tau]
        return sum(p * (PROBE_COST + count / 2**size) for p in probes)

    return min(range(2, radius + 2), key=cost)


def partition_bits(corr: np.ndarray, parts: int) -> list[list[int]]:
    """Bits of each part: the bit most correlated with those left starts a part, and the bits most correlated with the part follow."""
    left, out = set(range(BITS)), []
    for k in range(parts):
        size = len(left) // (parts - k)
        rest = sorted(left)
        part = [max(rest, key=lambda b: (corr[b, rest].sum(), -b))]
        while len(part) < size:
            part.append(max((b for b in rest if b not in part), key=lambda b: (corr[b, part].sum(), -b)))
        out.append(sorted(part))
        left -= set(part)
    return out


def extract(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """Values of a part: its bits side by side."""
    out = np.zeros(len(fps), np.uint64)
    for k, b in enumerate(bits):
        out |= (fps >> np.uint64(b) & np.uint64(1)) << np.uint64(k)
    return out


def thresholds(fps: np.ndarray, sample: np.ndarray, count: int, parts: list[list[int]], radius: int = RADIUS) -> np.ndarray:
    """Thresholds (rows: fingerprints, columns: parts) of least estimated cost with sum radius - parts + 1."""
    spare, options = radius - len(parts) + 1, range(-1, radius + 1)
    best: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {0: (np.zeros(len(fps)), [])}
    for bits in parts:
        far = np.bitwise_count(extract(fps, bits)[:, None] ^ extract(sample, bits)[None, :])
        step: dict[int, tuple[np.ndarray, list[np.ndarray]]] = {}
        for t in options:
            probes = sum(comb(len(bits), x) for x in range(t + 1))
            cost = PROBE_COST * probes + count * np.maximum((far <= t).sum(1) / max(1, len(sample)) if t >= 0 else 0, probes / 2 ** len(bits))
            for s, (had, chosen) in best.items():
                total = had + cost
                column = np.full(len(fps), t, np.int8)
                if s + t in step:
                    old, before = step[s + t]
                    better = total < old
                    step[s + t] = (np.where(better, total, old), [np.where(better, a, b) for a, b in zip([*chosen, column], before, strict=True)])
                else:
                    step[s + t] = (total, [*chosen, column])
        best = step
    return np.stack(best[spare][1], 1)


def _masks(bits: int, t: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for x in range(t + 1) for c in itertools.combinations(range(bits), x)], np.uint64)


#: A row is stored in its bucket (1), probes it (2), or both.
STORED, PROBES = 1, 2


def probe_rows(nodes: DataFrame, sample: np.ndarray, count: int, parts: list[list[int]], radius: int = RADIUS) -> DataFrame:
    """bucket, fp, kind of every distinct fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {(len(bits), t): _masks(len(bits), t) for bits in parts for t in range(radius + 1)}
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                fps = whole.column(0).slice(at, 2048).to_numpy().view(np.uint64)
                chosen = thresholds(fps, sample, count, parts, radius)
                for k, bits in enumerate(parts):
                    own = extract(fps, bits)
                    for t in range(-1, radius + 1):
                        at_t = chosen[:, k] == t
                        if not at_t.any():
                            continue
                        f, v = fps[at_t], own[at_t]
                        values = (v[:, None] ^ masks[len(bits), t][None, :]) if t >= 0 else v[:, None]
                        kind = np.full(values.shape, PROBES, np.int8)
                        kind[:, 0] = STORED | PROBES if t >= 0 else STORED
                        yield pa.record_batch([pa.array((values.ravel() | np.uint64(k << 56)).view(np.int64)), pa.array(np.repeat(f, values.shape[1]).view(np.int64)), pa.array(kind.ravel())], ["bucket", "fp", "kind"])

    return nodes.select("fp").mapInArrow(run, "bucket long, fp long, kind byte")


def forest(fps: np.ndarray, kinds: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, least node of its tree) that connect what a probe of the group links."""
    q, d = np.flatnonzero(kinds & PROBES), np.flatnonzero(kinds & STORED)
    if not len(q) or not len(d):
        return fps[:0], fps[:0]
    a, b = [], []
    for at in range(0, len(q), 512):
        x, y = np.nonzero(np.bitwise_count(fps[q[at : at + 512], None] ^ fps[None, d]) <= radius)
        a.append(q[at + x]), b.append(d[y])
    a, b = np.concatenate(a), np.concatenate(b)
    other = fps[a] != fps[b]
    a, b = a[other], b[other]
    root = np.arange(len(fps))
    while len(a):
        low = np.minimum(root[a], root[b])
        nxt = root.copy()
        np.minimum.at(nxt, root[a], low)
        np.minimum.at(nxt, root[b], low)
        nxt = nxt[nxt]
        if (nxt == root).all():
            break
        root = nxt
    moved = np.flatnonzero(root != np.arange(len(fps)))
    return fps[moved], fps[root[moved]]


def links(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """u, v: edges that connect linked fingerprints, from the buckets' groups."""
    large = rows.groupBy("bucket").count().filter(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    cut = rows.join(large, "bucket", "left").withColumn("own", F.when(F.col("blocks").isNotNull(), F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).otherwise(0))
    cut = cut.withColumn("with", F.explode(F.when(F.col("blocks").isNotNull(), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))))
    cut = cut.select("bucket", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "fp", "kind")
    dealt = cut.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def groups(key: np.ndarray, fp: np.ndarray, kind: np.ndarray) -> pa.RecordBatch:
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
            starts, ends = [0, *cuts.tolist()], [*cuts.tolist(), len(fp)]
            made = [forest(fp[a:b], kind[a:b], radius) for a, b in zip(starts, ends, strict=True) if b - a > 1]
            u = np.concatenate([x for x, _ in made] + [fp[:0]])
            v = np.concatenate([y for _, y in made] + [fp[:0]])
            return pa.record_batch([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            key = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in range(3)], 1)
            now = [key, batch.column(3).to_numpy().view(np.uint64), batch.column(4).to_numpy()]
            now = [np.concatenate([a, b]) for a, b in zip(held, now, strict=True)] if held else now
            if not len(now[1]):
                continue
            open_ = (now[0] == now[0][-1]).all(1)  # the last group may go on in the next batch
            first = int(np.flatnonzero(open_)[0])
            if first:
                yield groups(*[x[:first] for x in now])
            held = [x[first:] for x in now]
        if held:
            yield groups(*held)

    return dealt.mapInArrow(run, "u long, v long")


def near(spark: SparkSession, nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """u, v: edges that connect distinct fingerprints (fp) at ``radius`` or fewer differing bits."""
    count = nodes.count()
    parts = partition_bits(correlations(nodes, count), count_parts(count, radius))
    sample = np.array([r[0] for r in nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64).view(np.uint64)
    return links(materialize(spark, probe_rows(nodes, sample, count, parts, radius), "probes"), radius)


def components(spark: SparkSession, docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp and component_id of every row."""
    prints = materialize(spark, fingerprints(docs, shingle), "fingerprints")
    nodes = materialize(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    root = roots(spark, near(spark, nodes, radius))
    placed = nodes.join(root, nodes["fp"] == root["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(placed.join(ids, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def first_rows(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows whose doc_id is the component_id that ``found`` has for it, one for each doc_id, and those without a doc_id; columns as they were."""
    ids = found.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("doc_id") == F.col("component_id")), F.lit(False)).alias("first"))
    ids = materialize(spark, ids.select(F.col("doc_id").alias("_own_id"), "n", "first"), "ids")
    first, rest = ids.filter("first"), ids.filter("NOT first")
    if rest.count() <= FEW:  # so that no text is shuffled
        gone = F.broadcast(rest.select("_own_id"))
        out = docs.filter(docs["doc_id"].isNotNull()).join(gone, docs["doc_id"] == gone["_own_id"], "left_anti")
    else:
        out = docs.join(kept := first.select("_own_id"), docs["doc_id"] == kept["_own_id"], "left_semi")
    if first.filter("n > 1").limit(1).count():
        out = out.dropDuplicates(["doc_id"])
    return out.unionAll(docs.filter(docs["doc_id"].isNull()))


def keep_first(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``first_rows`` of the components."""
    return first_rows(spark, docs, components(spark, docs))


def hex_of(column: str):
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, table(spark, sf_dir, "documents")).select("doc_id", hex_of("fp").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash": op4_simhash}
ORACLES: dict[str, str] = {}
