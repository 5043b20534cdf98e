"""Removal of repeated passages by suffix order (operator 5).

A byte goes if a string of ``LENGTH`` bytes over it starts anywhere else too, in
the same document or another; matches never cross documents.

Strings meet in buckets: the least hash of ``ANCHOR`` bytes within a window of
``LENGTH`` bytes depends on the window alone, so equal windows have equal anchors.
Neighbouring windows of one anchor are a run; runs are grouped by the anchor's
hash. An anchor seen once has no repeats. A run whose whole content is seen twice
is repeated in all its windows. What is left, runs with one anchor and different
contents, is compared by content: windows whose hash recurs are candidates,
stretches of candidates that are equal byte by byte are repeated, and the rest
goes, bucket by bucket, through the column-wise construction: a collection's
Burrows-Wheeler transform and common prefixes, into which every string inserts one
symbol in each round, from its end on. The three columns (symbol, common prefix
with the suffix before, suffix) are passed through in order once in every round.
Windows whose common prefix with a neighbour reaches ``LENGTH`` are repeated.

No task holds an unbounded anchor: one with over ``HOT`` different contents is taken
apart into blocks of windows that have a piece in common, which are counted by hash,
combined before the shuffle; single windows are counted where different blocks share
a piece only. Aggregations on anchors are combined before the shuffle too; an
anchor that very many runs share is a few counters there, and one row for each
different content later. A collection is at most ``COLLECTION`` bytes and an anchor
more, so its columns stay in memory: no task writes to a folder of its machine.
Equality of whole runs, and of the windows of a hot anchor, is that of 128 bits.

Texts are known by their MD5, not by doc_id: rows with one text have one verdict,
whatever their ids. Nulls: a null text is empty (nothing removed); a null or a
repeated doc_id changes nothing. Repeated rows are documents of their own, repeat
each other, and give equal rows. Texts under ``LENGTH`` bytes are kept as they are;
an empty table gives no rows. Extra columns are not read by the query and are
carried by ``strip``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize, release, table, text_rows, tidy

LENGTH, ANCHOR = 200, 48
#: Window starts that are handled at once; bytes of content compared at once; bytes of one collection; different contents from which an anchor is taken apart; windows of a block.
SEGMENT, COMPARED, COLLECTION, HOT, GRID = 1 << 19, 1 << 20, 1 << 19, 1024, 16
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240101).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS, _INVERSES = _powers(_BASE, SEGMENT + LENGTH + 1), _powers(pow(_BASE, -1, 2**64), SEGMENT + LENGTH + 1)
_POSITION = np.uint64((1 << 20) - 1)


def _prefix(data: np.ndarray) -> np.ndarray:
    """Sums whose differences are polynomial hashes of spans."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _POWERS[: len(data)], out=out[1:])
    return out


def _spans(prefix: np.ndarray, a, b) -> np.ndarray:
    return (prefix[b] - prefix[a]) * _INVERSES[a]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xA0761D6478BD642F)
    return x ^ x >> np.uint64(32)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    y = np.concatenate([x, np.full(-len(x) % w, 2**64 - 1, np.uint64)]).reshape(-1, w)
    ahead = np.minimum.accumulate(y, 1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], 1)[:, ::-1].ravel()
    n = len(x) - w + 1
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """start, windows, anchor hash and content hash of the runs of at most SEGMENT window starts."""
    prefix, n = _prefix(data), len(data) - ANCHOR + 1
    h = _mix(_spans(prefix, slice(0, n), slice(ANCHOR, ANCHOR + n)))
    least = _sliding_min(h & ~_POSITION | np.arange(n, dtype=np.uint64), LENGTH - ANCHOR + 1)
    at = (least & _POSITION).astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    windows = np.diff(np.append(start, len(at)))
    return start, windows, h[at[start]], _mix(_spans(prefix, start, start + windows + LENGTH - 1))


def text_key(text: Column) -> Column:
    """128 bits that tell texts apart; null is the empty text."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and its key."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), text_key(F.col("text")).alias("key"))


#: A run's place: first window and number of windows.
def _pack(start: np.ndarray, windows: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 8 | windows


def _start(place: Column) -> Column:
    return F.shiftright(place, 8)


def _windows(place: Column) -> Column:
    return place.bitwiseAND(F.lit(255))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A text's different runs, each with all its places: a passage that fills a document is one row of it."""
    for ids, keys, texts in text_rows(batches, ("doc_id", "key", "text"), 256):
        anchors, contents, owners, places, counts = [], [], [], [], []
        for k, text in enumerate(texts):
            data = np.frombuffer(text.encode(), np.uint8)
            parts = []
            for at in range(0, max(0, len(data) - LENGTH + 1), SEGMENT):
                start, windows, anchor, content = runs_of(data[at : at + SEGMENT + LENGTH - 1])
                parts.append((anchor, content, _pack(start + at, windows)))
            if not parts:
                continue
            anchor, content, place = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((place, content, anchor))
            anchor, content = anchor[order], content[order]
            new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1])]))
            anchors.append(anchor[new]), contents.append(content[new]), places.append(place[order]), owners.append(k)
            counts.append(np.diff(np.append(new, len(anchor))))
        if anchors:
            owner = pa.array(np.repeat(owners, [len(x) for x in anchors]))
            offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(places)))
            hashes = [pa.array(np.concatenate(x).view(np.int64)) for x in (anchors, contents)]
            yield pa.record_batch([*hashes, pa.array(ids, pa.int64()).take(owner), pa.array(keys, pa.binary()).take(owner), lists], ["anchor", "content", "doc_id", "key", "places"])
    tidy()


def _lists(batch: pa.RecordBatch, name: str, fields: tuple[str, ...]) -> tuple[list[int], list[int], list[np.ndarray]]:
    """Where each row's list starts and ends, and the fields of all lists, without a Python object for each."""
    lists = batch.column(batch.schema.get_field_index(name))
    offsets = lists.offsets.to_numpy()
    return offsets[:-1].tolist(), offsets[1:].tolist(), [lists.values.field(f).to_numpy(zero_copy_only=False) for f in fields]


def _slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contents of the runs asked for."""
    for batch in _slices(batches, 128):
        first, last, (anchor, content, n, hot, start, windows) = _lists(batch, "wanted", ("anchor", "content", "n", "hot", "start", "windows"))
        texts, a, b = batch.column(batch.schema.get_field_index("text")).to_pylist(), first[0], last[-1]
        out = []
        for text, x, y in zip(texts, first, last, strict=True):
            data = text.encode()
            out += [data[p : p + w + LENGTH - 1] for p, w in zip(start[x:y].tolist(), windows[x:y].tolist(), strict=True)]
        yield pa.record_batch([pa.array(anchor[a:b]), pa.array(content[a:b]), pa.array(n[a:b]), pa.array(hot[a:b]), pa.array(out, pa.binary())], ["anchor", "content", "n", "hot", "bytes"])


_BLOCKS = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("once", pa.bool_()), ("piece", pa.int64()), ("back", pa.int64()), ("block", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("hashes", pa.list_(pa.int64()))])


def blocks_of(data: bytes, anchor: int) -> Iterator[tuple[int, int, int, int, int, np.ndarray]]:
    """piece, back, block, first, last and hashes of the blocks of a run: GRID windows at most, which have one piece in common.

    Pieces lie on a grid about the anchor, whose place is the same in equal windows; a window has one of them.
    back: windows before the piece. block: hash of all the block's bytes.
    """
    prefix, n = _prefix(np.frombuffer(data, np.uint8)), len(data) - LENGTH + 1
    h = _mix(_spans(prefix, slice(0, LENGTH - ANCHOR + 1), slice(ANCHOR, LENGTH + 1)))
    at = int(np.flatnonzero(h.view(np.int64) == anchor)[0])
    hashes = _mix(_spans(prefix, slice(0, n), slice(LENGTH, LENGTH + n))).view(np.int64)
    piece = np.arange(at % GRID, n + GRID - 1, GRID)
    first, last = np.maximum(piece - GRID + 1, 0), np.minimum(piece, n - 1)
    pieces = _mix(_spans(prefix, piece, piece + LENGTH - GRID + 1)).view(np.int64)
    blocks = _mix(_spans(prefix, first, last + LENGTH)).view(np.int64)
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        yield int(pieces[k]), int(piece[k]) - a, int(blocks[k]), a, b, hashes[a : b + 1]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of contents."""
    for anchors, contents, counts, data in text_rows(batches, ("anchor", "content", "n", "bytes"), 512):
        rows = [(a, c, n == 1, *b) for a, c, n, one in zip(anchors, contents, counts, data, strict=True) for b in blocks_of(one, a)]
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCKS, strict=True)], schema=_BLOCKS)


class Collection:
    """Transform and common prefixes of many strings, made column by column, right to left."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings = strings
        self.lengths = np.array([len(s) for s in strings])
        self.m = len(strings)
        width = int(self.lengths.max(initial=0))
        self.symbols = np.zeros((self.m, width), np.int16)  # right-aligned, 0 before a string's first symbol
        for k, s in enumerate(strings):
            self.symbols[k, width - len(s) :] = np.frombuffer(s, np.uint8).astype(np.int16) + 1

    def build(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common prefix with the suffix before (at most LENGTH), string and position of all suffixes in order; empty suffixes are left out."""
        m, width = self.m, self.symbols.shape[1]
        symbol, common, suffix = np.zeros(m, np.int16), np.zeros(m, np.uint8), np.arange(m, dtype=np.int64) << 32
        where, live = np.arange(m), np.arange(m)  # place of each string's longest suffix so far; strings that go on
        for t in range(1, width + 1):
            column = self.symbols[:, width - t]
            live = live[column[live] > 0]
            if not len(live):
                break
            size = len(symbol)
            symbol[where[live]] = column[live]
            order = np.argsort(symbol, kind="stable")
            order = order[int((symbol == 0).sum()) :]  # no symbol goes before strings that have ended
            new = np.zeros(size, bool)
            new[where[live]] = True
            at = np.flatnonzero(new[order])  # ranks, among all longer suffixes, of those inserted now
            owner = np.empty(size, np.int64)
            owner[where[live]] = live
            owner = owner[order[at]]
            before = self._joined(symbol, common, order, at - 1, at)
            after = self._joined(symbol, common, order, at, at + 1)
            total = m + len(order)
            fresh = np.zeros(total, bool)
            fresh[m + at] = True
            grown = []
            for old, kind in ((symbol, np.int16), (common, np.uint8), (suffix, np.int64)):
                out = np.empty(total, kind)
                out[~fresh] = old
                grown.append(out)
            symbol, common, suffix = grown
            symbol[m + at], suffix[m + at] = 0, owner << 32 | self.lengths[owner] - t
            follows = m + at + 1
            inside = follows < total
            common[follows[inside]] = after[inside]
            common[m + at] = before
            where[owner] = m + at
        return common[m:], (suffix[m:] >> 32).astype(np.int64), suffix[m:] & 0xFFFFFFFF

    @staticmethod
    def _joined(symbol, common, order, left, right) -> np.ndarray:
        """Common prefixes of the suffixes of two neighbouring ranks: one more than between what follows their first symbols."""
        out = np.zeros(len(left), np.uint8)
        k = np.flatnonzero((left >= 0) & (right < len(order)))
        k = k[symbol[order[left[k]]] == symbol[order[right[k]]]]
        if len(k):
            a, b = order[left[k]] + 1, order[right[k]] + 1
            pairs = np.empty(2 * len(k), np.int64)
            pairs[::2], pairs[1::2] = a, b
            least = np.minimum.reduceat(np.append(common, np.uint8(255)), pairs)[::2]
            out[k] = np.minimum(least.astype(np.int16) + 1, LENGTH)
        return out


def repeated(strings: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its windows start in at least two places of the collection."""
    out = [np.zeros(max(0, len(s) - LENGTH + 1), bool) for s in strings]
    if strings:
        common, string, at = Collection(strings).build()
        far = common >= LENGTH
        for k in np.flatnonzero(far | np.append(far[1:], False)).tolist():
            out[string[k]][at[k]] = True
    return out


def _stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last position of each run of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def compare(rows: list[tuple[int, int, int, bytes]]) -> list[tuple[int, int, int, int]]:
    """anchor, content, first and last repeated window, of runs (anchor, content, count, bytes) that occur once; whole anchors only."""
    rows = list({(r[0], r[1]): r for r in rows}.values())
    hashes, sizes = [], []
    for _, _, _, data in rows:
        prefix, n = _prefix(np.frombuffer(data, np.uint8)), len(data) - LENGTH + 1
        hashes.append(_spans(prefix, slice(0, n), slice(LENGTH, LENGTH + n)))
        sizes.append(n)
    _, inverse, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    recurs = np.split(counts[inverse] > 1, np.cumsum(sizes)[:-1])
    places: dict[tuple[int, bytes], list[tuple[int, int]]] = defaultdict(list)
    for k, (anchor, _, _, data) in enumerate(rows):
        for a, b in _stretches(recurs[k]):
            places[anchor, data[a : b + LENGTH]].append((k, a))
    out, open_ = [], {key[0] for key, at in places.items() if len(at) == 1 and rows[at[0][0]][2] == 1}
    waiting, held = [], 0

    def settle() -> None:
        for (_, at), flags in zip(waiting, repeated([data for data, _ in waiting]), strict=True):
            for k, first in at:
                if rows[k][2] == 1:
                    out.extend((rows[k][0], rows[k][1], first + a, first + b) for a, b in _stretches(flags))

    last = None
    for (anchor, data), at in places.items():
        if len(at) > 1 or anchor not in open_:
            out.extend((anchor, rows[k][1], a, a + len(data) - LENGTH) for k, a in at if rows[k][2] == 1)
        if anchor in open_:
            if held >= COLLECTION and anchor != last:
                settle()
                waiting, held = [], 0
            waiting.append((data, at if len(at) == 1 else []))
            held, last = held + len(data), anchor
    settle()
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by anchor; an anchor's rows may span batches."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0

    def made(rows) -> pa.RecordBatch:
        found = compare(rows) if rows else []
        return pa.record_batch([pa.array([r[k] for r in found], pa.int64()) for k in range(4)], ["anchor", "content", "first", "last"])

    for columns in text_rows(batches, ("anchor", "content", "n", "bytes"), 1024):
        for row in zip(*columns, strict=True):
            if size >= COMPARED and row[0] != held[-1][0]:
                yield made(held)
                held, size = [], 0
            held.append(row)
            size += len(row[3])
    yield made(held)
    tidy()


def _hot_windows(spark: SparkSession, contents: DataFrame) -> DataFrame:
    """anchor, content, first and last repeated window of the contents (that occur once) of hot anchors.

    Blocks that are equal as a whole are repeated in all their windows. Windows are told apart only in blocks that share
    their piece with a different block, one of each kind.
    """
    blocks = contents.mapInArrow(_blocks, "anchor long, content long, once boolean, piece long, back long, block long, first long, last long, hashes array<long>")
    kinds = blocks.groupBy("anchor", "piece", "back", "block").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("content", "first", "once", "hashes")).alias("one"))
    kinds = materialize(spark, kinds, "kinds")
    several = kinds.groupBy("anchor", "piece").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor", "piece")
    windows = kinds.join(several, ["anchor", "piece"]).select("anchor", "n", "one.content", "one.first", "one.once", F.posexplode("one.hashes").alias("k", "hash"))
    recurs = materialize(spark, windows.groupBy("anchor", "hash").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor", "hash"), "recurring")
    at = F.col("first") + F.col("k")
    single = windows.filter("n = 1 and once").join(recurs, ["anchor", "hash"]).select("anchor", "content", at.alias("first"), at.alias("last"))
    whole = blocks.filter("once").select("anchor", "piece", "back", "block", "content", "first", "last").join(kinds.filter("n > 1").select("anchor", "piece", "back", "block"), ["anchor", "piece", "back", "block"])
    found = whole.select("anchor", "content", "first", "last").unionByName(single)
    w = W.partitionBy("anchor", "content").orderBy("first")
    new = F.coalesce(F.col("first") > F.lag("last").over(w) + 1, F.lit(True)).cast("int")
    found = found.withColumn("new", new).withColumn("stretch", F.sum("new").over(w))
    return found.groupBy("anchor", "content", "stretch").agg(F.min("first").alias("first"), F.max("last").alias("last")).select("anchor", "content", "first", "last")


def spans(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """key of texts, and the spans (arrays of first byte, byte after) to remove, of those that have any."""
    keyed = _key(docs)
    runs = keyed.filter(F.octet_length("text") >= LENGTH).select("doc_id", "key", "text").mapInArrow(_runs, "anchor long, content long, doc_id long, key binary, places array<long>")
    seen = runs.groupBy("anchor").agg(F.sum(F.size("places")).alias("n"), F.min("content").alias("low"), F.max("content").alias("high")).filter("n > 1")
    # written, so that both sides of the join are plain exchanges, of which Spark can split a hot anchor's part
    seen = materialize(spark, seen.select("anchor", (F.col("low") != F.col("high")).alias("many")), "anchors")
    release(spark)
    shared = materialize(spark, runs.join(seen, "anchor"), "runs")
    release(spark)
    many = shared.filter("many").groupBy("anchor", "content").agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("key", "doc_id", F.col("places")[0].alias("place"))).alias("one"))
    many = materialize(spark, many.select("anchor", "content", "n", "one.*"), "contents")
    crowded = materialize(spark, many.groupBy("anchor").agg(F.count(F.lit(1)).alias("contents")).filter(F.col("contents") > hot).select("anchor", F.lit(True).alias("crowded")), "hot-anchors")
    place = F.col("place")
    asked = many.join(crowded, "anchor", "left").withColumn("hot", F.coalesce("crowded", F.lit(False)))
    wanted = asked.groupBy(F.col("key").alias("of"), F.col("doc_id").alias("of_id")).agg(F.collect_list(F.struct("anchor", "content", "n", "hot", _start(place).alias("start"), _windows(place).alias("windows"))).alias("wanted"))
    texts = keyed.filter(F.octet_length("text") >= LENGTH).groupBy("key", "doc_id").agg(F.first("text").alias("text"))
    contents = texts.join(wanted, (F.col("key") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("of_id"))).select("text", "wanted").mapInArrow(_extract, "anchor long, content long, n long, hot boolean, bytes binary")
    any_hot = crowded.limit(1).count() > 0
    if any_hot:
        contents = materialize(spark, contents, "extracts")
    cold = contents.filter("not hot").select("anchor", "content", "n", "bytes")
    verdict = cold.repartition("anchor").sortWithinPartitions("anchor", "content").mapInArrow(_compare, "anchor long, content long, first long, last long")
    if any_hot:
        verdict = verdict.unionByName(_hot_windows(spark, contents.filter("hot")))
    verdict = materialize(spark, verdict, "verdicts")
    release(spark)
    twice = many.filter("n > 1").select("anchor", "content", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last"))
    found = shared.filter("many").join(twice.unionByName(verdict), ["anchor", "content"]).select("key", "places", "first", "last")
    found = found.unionByName(shared.filter("not many").select("key", "places", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))
    ends = F.transform("places", lambda p: F.struct((_start(p) + F.col("first")).alias("a"), (_start(p) + F.coalesce("last", _windows(p) - 1) + LENGTH).alias("b")))
    # a set: rows with one text bring the same spans
    out = materialize(spark, found.select("key", ends.alias("ends")).groupBy("key").agg(F.flatten(F.collect_set("ends")).alias("spans")), "spans")
    discard(seen, shared, many, crowded, verdict, *[contents] * any_hot)
    release(spark)
    return out


def joined(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and spans (null: none) of every row."""
    return _key(docs).join(spans(spark, docs), "key", "left").select("doc_id", "text", "spans")


def merged(first: np.ndarray, after: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping and touching spans as one."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(after[order])
    new = np.flatnonzero(np.concatenate([[True], first[1:] > reach[:-1]]))
    return list(zip(first[new].tolist(), reach[np.append(new[1:], len(first)) - 1].tolist(), strict=True))


def kept(data: bytes, gone: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in gone for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def strip_text(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the merged spans; a character that a span cuts stays whole."""
    data = text.encode()
    gone = []
    for a, b in spans:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        gone.append((a, b))
    return kept(data, gone).decode()


def strip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows with repeated passages taken out of ``text`` (and ``n_chars`` counted anew); rows that lose all their words that way are left out."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), text_key(F.col("text")).alias("key")).join(spans(spark, docs), "key", "left")

    @F.pandas_udf("string")
    def stripped(texts: pd.Series, first: pd.Series, after: pd.Series) -> pd.Series:
        return pd.Series([t if a is None or t is None else strip_text(t, merged(np.asarray(a), np.asarray(b))) for t, a, b in zip(texts, first, after, strict=True)], dtype=object)

    # a Generate, so that the filter stays above the function
    rows = rows.select("row", F.col("spans").isNull().alias("whole"), F.explode(F.array(stripped(F.col("row.text"), F.col("spans.a"), F.col("spans.b")))).alias("text"))
    rows = rows.filter(F.col("whole") | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches, 256):
        first, last, (a, b) = _lists(batch, "spans", ("a", "b"))
        ids, texts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("doc_id", "text"))
        rows = []
        for doc_id, text, x, y in zip(ids, texts, first, last, strict=True):
            data, gone = text.encode(), merged(a[x:y], b[x:y])
            rows.append((doc_id, len(data), sum(q - p for p, q in gone), len(gone), hashlib.sha256(kept(data, gone)).hexdigest()))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _DIGEST, strict=True)], schema=_DIGEST)


def removed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Digest of what each document keeps."""
    return joined(spark, docs).mapInArrow(_digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op5_suffix_dedup": op5_suffix_dedup}
ORACLES: dict[str, str] = {}
