"""Mixing sources to target weights (operator 1), DataFrame functions only.

Sizes are words. Each source is one line: its documents end to end, in the order
of a hash of their id, cut into blocks of ``BLOCK`` words (the last one may be
shorter). The schedule has a slot for every block that the targets ask for: slot i's
golden-ratio point ``frac((i + 1) / phi)`` is mapped through the cumulative targets to
a source, the slots of a source are ranked, and rank r takes the block that stands at
place ``r mod blocks`` of the source's shuffled blocks, in epoch ``r div blocks``; the
last slot of a source takes the words that are left. Blocks are shuffled by a
multiplication modulo their number, so a block knows its place without any sort.

A source gets exactly its quota of slots: the sequence gives each source its share
within a few slots; ranks beyond the quota are left out, and missing ranks come at
the schedule's end. So a source's words come to its target, rounded, and the order of
the slots decides when, and in a part of an epoch which, blocks are taken.

Nothing gathers a source in one task: positions on a line and ranks are made in
two steps, totals of bounded buckets first, then positions within a bucket. Only
the table of sources (one row for each source) is ordered as a whole.

Nulls: a null text has size 0; null is a source of its own, after all others. A
null doc_id sorts before all hashes of its source. Repeated rows are placed one
after the other and counted each; documents of size 0 and sources without words
take nothing (target 0). Extra columns are carried by ``take``, whatever their names.
An empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD_PATTERN, materialize, table

BLOCK = 256
#: Words asked for, as a share of all words; most often that a word is taken; weights by position of the source.
SHARE, MOST, WEIGHTS = 1.5, 2, (5, 2, 1)
#: Rows in a bucket of the lines, and slots in a chunk of the schedule, at about.
BUCKET_ROWS, CHUNK_SLOTS = 256, 1024
PHI = (math.sqrt(5) - 1) / 2
#: Primes of which one shares no factor with any number of blocks.
SHUFFLE = (1_000_003, 1_000_033)


def place(block_no: Column | str, blocks: Column | str) -> Column:
    """Where a block stands among the shuffled blocks of its source."""
    b, n = (F.col(c) if isinstance(c, str) else c for c in (block_no, blocks))
    return (b * F.when(n % SHUFFLE[0] == 0, F.lit(SHUFFLE[1])).otherwise(F.lit(SHUFFLE[0])).cast("long")) % n


def source_targets(sized: DataFrame) -> DataFrame:
    """One row per source: has_source, source, source_size, weight, target, words (to take), cumulative bounds lo and hi of slots.

    Targets are ``least(MOST * source_size, level * weight)``, at the one level that
    makes them sum to the share: sources are full in the order of
    ``MOST * source_size / weight``, so the level follows from running sums.
    """
    s = sized.groupBy(F.col("source").isNotNull().alias("has_source"), F.coalesce("source", F.lit("")).alias("source")).agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.desc("has_source"), "source")
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("double"))
    full = (F.lit(MOST) * F.col("source_size")).cast("double")
    by_ratio = W.orderBy(full / F.col("weight"), F.desc("has_source"), "source")
    before, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    s = s.withColumn("full", full).withColumn("ratio", full / F.col("weight"))
    s = s.withColumn("asked", F.lit(SHARE) * F.sum("source_size").over(whole))
    s = s.withColumn("level_here", (F.col("asked") - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    s = s.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(whole))
    s = s.withColumn("target", F.coalesce(F.least("full", F.col("level") * F.col("weight")), F.col("full")))
    s = s.withColumn("words", F.floor(F.col("target") + 0.5).cast("long"))
    return s.select("has_source", "source", "source_size", "weight", "target", "words")


def with_slots(sources: DataFrame, block: int) -> DataFrame:
    """Adds blocks (of the line), lacks (words that the last block is short of), short_at (its place), slots (quota), and the source's bounds lo, hi among all slots."""
    s = sources.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    s = s.withColumn("lacks", F.col("blocks") * block - F.col("source_size")).withColumn("short_at", F.when(F.col("blocks") > 0, place(F.col("blocks") - 1, "blocks")))
    rest = F.expr("words - (words div source_size) * source_size")
    some = F.ceil(rest / block).cast("long")  # blocks of the last epoch, one more if the short one among them leaves too little
    some = F.when(F.col("short_at") < some, F.ceil((rest + F.col("lacks")) / block).cast("long")).otherwise(some)
    s = s.withColumn("slots", F.when(F.col("source_size") > 0, F.expr("words div source_size") * F.col("blocks") + some).otherwise(0).cast("long"))
    order = W.orderBy(F.desc("has_source"), "source")
    return s.withColumn("hi", F.sum("slots").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("lo", F.col("hi") - F.col("slots"))


def schedule(spark: SparkSession, sources: DataFrame, block: int) -> DataFrame:
    """slot, has_source, source, rank, at_place, epoch and words of every slot of the mix."""
    total = sources.agg(F.sum("slots")).first()[0] or 0
    point = F.expr(f"(id + 1) * {PHI!r}D - floor((id + 1) * {PHI!r}D)") * F.lit(float(total))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(point).cast("long").alias("point"), F.expr(f"id div {CHUNK_SLOTS}").alias("chunk"))
    # the table of sources is small but of no proven bound: cells of the unit line that a source covers meet slots by equality
    cell = max(1, -(-total // 1024))
    cells = sources.filter("slots > 0").select("has_source", "source", "lo", "hi", F.explode(F.expr(f"sequence(lo div {cell}L, (hi - 1) div {cell}L)")).alias("cell"))
    slots = slots.withColumn("point", F.least("point", F.lit(max(0, total - 1)))).withColumn("cell", F.expr(f"point div {cell}L"))
    slots = slots.join(cells, "cell").filter("point >= lo and point < hi")
    in_chunk = slots.groupBy("chunk", "lo").agg(F.count(F.lit(1)).alias("n"))
    before = in_chunk.withColumn("before", F.sum("n").over(W.partitionBy("lo").orderBy("chunk")) - F.col("n")).select("chunk", "lo", "before")
    ranked = slots.withColumn("within", F.row_number().over(W.partitionBy("chunk", "lo").orderBy("slot")) - 1)
    ranked = ranked.join(before, ["chunk", "lo"]).select("slot", "lo", (F.col("before") + F.col("within")).alias("rank"))
    got = in_chunk.groupBy("lo").agg(F.sum("n").alias("got"))
    quota = sources.filter("slots > 0")
    missing = quota.join(got, "lo", "left").filter("slots > coalesce(got, 0)").select(F.expr(f"{total}L + lo").alias("slot"), "lo", F.explode(F.expr("sequence(coalesce(got, 0), slots - 1)")).alias("rank"))
    out = ranked.unionByName(missing).join(quota.select("lo", "has_source", "source", "source_size", "words", "blocks", "lacks", "short_at", "slots"), "lo").filter("rank < slots")
    out = out.withColumn("epoch", F.expr("rank div blocks")).withColumn("at_place", F.expr("rank % blocks"))
    before = F.col("at_place") * block - F.when(F.col("at_place") > F.col("short_at"), F.col("lacks")).otherwise(0)
    own = F.lit(block) - F.when(F.col("at_place") == F.col("short_at"), F.col("lacks")).otherwise(0)
    left = F.col("words") - F.col("epoch") * F.col("source_size") - before
    return out.select("slot", "has_source", "source", "rank", "at_place", "epoch", F.least(own, left).cast("long").alias("slot_words"))


def lines(sized: DataFrame) -> DataFrame:
    """Adds ``at``, the document's first position on its source's line, and has_source; ``row`` tells repeated rows apart."""
    n = sized.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    key = F.md5(F.col("doc_id").cast("string"))
    d = sized.withColumn("has_source", F.col("source").isNotNull()).withColumn("source", F.coalesce("source", F.lit("")))
    key = F.concat(key, *[F.hex(c) for c in sized.columns if c == "tag"])
    d = d.withColumn("key", F.coalesce(key, F.lit(""))).withColumn("bucket", F.floor(F.conv(F.concat(F.lit("0"), F.substring("key", 1, 8)), 16, 10).cast("double") * buckets / float(2**32)).cast("long"))
    totals = d.groupBy("has_source", "source", "bucket").agg(F.sum("size").alias("words"))
    before = totals.withColumn("before", F.sum("words").over(W.partitionBy("has_source", "source").orderBy("bucket")) - F.col("words")).drop("words")
    w = W.partitionBy("has_source", "source", "bucket").orderBy("key", "size")
    d = d.withColumn("row", F.row_number().over(w)).withColumn("within", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    return d.join(before, ["has_source", "source", "bucket"]).withColumn("at", F.col("before") + F.col("within")).drop("before", "within", "key")


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))


def pieces(spark: SparkSession, sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mix itself, one row for each run of words that a slot takes of a document: slot, epoch and first_word, words; null slot where none takes any.

    With them the columns of ``sized`` (doc_id, source, size and, where given, tag), row (which tells repeated rows apart) and the source's size and target.
    """
    sized = materialize(spark, sized, "mix-sizes")
    sources = materialize(spark, with_slots(source_targets(sized), block), "mix-sources")
    asked = schedule(spark, sources, block).select("has_source", "source", "at_place", "slot", "epoch", "slot_words")
    whole = sources.select("has_source", "source", "source_size", "target", "blocks")
    placed = lines(sized).join(F.broadcast(whole) if _small(whole) else whole, ["has_source", "source"])
    parts = placed.withColumn("block_no", F.explode_outer(F.expr(f"case when size > 0 then sequence(at div {block}L, (at + size - 1) div {block}L) end"))).withColumn("at_place", place("block_no", "blocks"))
    first = F.greatest(F.col("at"), F.col("block_no") * block) - F.col("block_no") * block
    last = F.least(F.col("at") + F.col("size"), (F.col("block_no") + 1) * block) - F.col("block_no") * block
    parts = parts.withColumns({"first_word": F.col("block_no") * block + first - F.col("at"), "_first": first, "_last": last})
    rows = parts.join(asked, ["has_source", "source", "at_place"], "left")
    rows = rows.withColumn("words", F.greatest(F.lit(0), F.least(F.col("_last"), F.coalesce("slot_words", F.lit(0))) - F.col("_first")).cast("long"))
    return rows.withColumn("slot", F.when(F.col("words") > 0, F.col("slot"))).drop("_first", "_last", "slot_words", "block_no", "at_place", "blocks", "at")


def mix(spark: SparkSession, sized: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and first_slot (where the mix first takes of it) of every row of doc_id, source, size."""
    own = [c for c in ("tag",) if c in sized.columns]
    keys = ["has_source", "source", "bucket", "row", "doc_id", *own, "size", "source_size", "target"]
    out = pieces(spark, sized, block).groupBy(*keys).agg(F.sum("words").cast("long").alias("taken"), F.min("slot").alias("first_slot"))
    return out.select("doc_id", *own, F.when(F.col("has_source"), F.col("source")).alias("source"), "size", "source_size", "target", "taken", "first_slot")


def take(spark: SparkSession, docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed rows, columns as they were: a row as often as the mix takes it whole, and once more with its first words only where the mix ends inside it.

    Rows of equal doc_id, source and text count as one document. ``n_chars`` of a row that is cut is counted anew.
    """
    tag = F.xxhash64(F.coalesce("text", F.lit("")))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", tag.alias("tag"), F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"))
    mixed = mix(spark, sized, block).groupBy("doc_id", "tag", "source", "size").agg(F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n")).filter("taken > 0")
    mixed = materialize(spark, mixed, "mix-taken")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"), tag.alias("_tag"))
    # of rows of equal id, source and text one stands for all: the least by its other columns
    if mixed.filter("n > 1").limit(1).count():
        kept = rows.groupBy("_id", "_source", "_tag").agg(F.min(F.to_json("row")).alias("_least"))
        once = rows.withColumn("_json", F.to_json("row")).join(kept.select(F.col("_id").alias("_i"), F.col("_source").alias("_s"), F.col("_tag").alias("_t"), "_least"), F.col("_id").eqNullSafe(F.col("_i")) & F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_tag") == F.col("_t")) & (F.col("_json") == F.col("_least")))
        rows = once.select("row", "_id", "_source", "_tag").dropDuplicates(["_id", "_source", "_tag"])
    m = mixed
    rows = rows.join(m, rows["_id"].eqNullSafe(m["doc_id"]) & rows["_source"].eqNullSafe(m["source"]) & (rows["_tag"] == m["tag"]))
    rest = F.expr("taken % size")
    rows = rows.select("row", rest.alias("rest"), F.explode(F.expr("sequence(1L, cast(ceil(taken / size) as bigint))")).alias("k"), F.expr("taken div size").alias("whole"))
    pieces = F.regexp_extract_all(F.col("row.text"), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), 0)
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("rest").cast("int")), "")
    text = F.when(F.col("k") <= F.col("whole"), F.col("row.text")).otherwise(cut)
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("k") <= F.col("whole"), F.col("row.n_chars")).otherwise(F.length(cut).cast("long"))
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def _small(sources: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of sources may be broadcast: its size is checked."""
    return sources.limit(most + 1).count() <= most


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark, sizes(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


QUERIES = {"op1_mixing": op1_mixing}
ORACLES = {
    "op1_mixing": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, case (row_number() over (order by source is null, source) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight from s
), r as (
  select *, (2 * source_size)::double as full_size, (2 * source_size)::double / weight as ratio from w
), v as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(full_size) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0))
    / (sum(weight) over () - coalesce(sum(weight) over (order by ratio, source is null, source rows between unbounded preceding and 1 preceding), 0)) as level_here from r
), t as (
  select source, source_size, coalesce(least(full_size, weight * max(level_here) filter (where level_here <= ratio) over ()), full_size) as target from v
), q0 as (
  select *, floor(target + 0.5)::bigint as words, (source_size + 255) // 256 as blocks from t
), q1 as (
  select *, blocks * 256 - source_size as lacks, case when blocks % 1000003 = 0 then 1000033 else 1000003 end as prime, case when source_size > 0 then words % source_size else 0 end as rest from q0
), q2 as (
  select *, case when blocks > 0 then ((blocks - 1) * prime) % blocks end as short_at, (rest + 255) // 256 as n_rest from q1
), q3 as (
  select *, case when source_size > 0 then (words // source_size) * blocks + case when short_at < n_rest then (rest + lacks + 255) // 256 else n_rest end else 0 end::bigint as slots from q2
), q as (
  select *, (sum(slots) over (order by source is null, source))::bigint as hi, (sum(slots) over (order by source is null, source) - slots)::bigint as lo, (sum(slots) over ())::bigint as total from q3
), points as (
  select i, total, least(total - 1, floor(((i + 1) * 0.6180339887498949::double - floor((i + 1) * 0.6180339887498949::double)) * total)::bigint) as point
  from (select unnest(range(total)) as i, total from (select max(total) as total from q))
), ranked as (
  select q.source, i as slot, row_number() over (partition by lo order by i) - 1 as rank from points join q on point >= lo and point < hi
), got as (
  select source, count(*) as n from ranked group by source
), every as (
  select * from ranked
  union all
  select source, total + lo, unnest(range(n, slots)) from (select q.source, total, lo, slots, coalesce(n, 0) as n from q left join got on got.source is not distinct from q.source where slots > 0)
), asked as (
  select q.source, slot, rank % blocks as at_place, least(256 - case when rank % blocks = short_at then lacks else 0 end,
    words - (rank // blocks) * source_size - ((rank % blocks) * 256 - case when rank % blocks > short_at then lacks else 0 end)) as slot_words
  from every join q on every.source is not distinct from q.source where rank < slots
), p as (
  select *, row_number() over () as rid, coalesce(sum(size) over (partition by source order by coalesce(md5(doc_id::varchar), ''), size rows between unbounded preceding and 1 preceding), 0)::bigint as first_at from d
), b as (
  select p.*, blocks, prime, unnest(range(first_at // 256, (first_at + size - 1) // 256 + 1)) as block_no from p join q on p.source is not distinct from q.source where size > 0
), x as (
  select rid, slot, greatest(0, least(least(first_at + size, (block_no + 1) * 256) - block_no * 256, slot_words) - (greatest(first_at, block_no * 256) - block_no * 256)) as n
  from b join asked on asked.source is not distinct from b.source and at_place = (block_no * prime) % blocks
), y as (
  select rid, sum(n)::bigint as taken, (min(slot) filter (where n > 0))::bigint as first_slot from x group by rid
)
select doc_id, size, q.source_size, q.target, coalesce(taken, 0)::bigint as taken, first_slot from p join q on p.source is not distinct from q.source left join y using (rid)"""
}
