"""Every operator against a brute-force version, on a fixture of awkward rows: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from threadloom.llm import byte_bpe, media_ts, mixing, quality_qda, quality_rules, simhash, suffix_dedup, token_files, toxicity, warc
from threadloom.llm.common import fresh_dir
from threadloom.llm.components import roots

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
RNG = random.Random(11)
VOCAB = ["Das", "haus", "the", "und", "zwölf", "naïve", "x1", "été", "日本", "a", "of", "###", "go,"]


def prose(n):
    return " ".join(RNG.choice(VOCAB) + str(RNG.randint(0, 99)) for _ in range(n))


PASSAGE = prose(60)
ROWS = [
    (1, prose(40), "a", "row"), (2, None, "a", "tag"), (3, "", "b", None), (4, " \n\t ", None, "x"), (5, prose(30) + PASSAGE + prose(20), "b", "x"), (6, PASSAGE + " " + prose(25), "c", "x"),
    (7, prose(3000), "c", "x"), (8, "word", "d", "x"), (9, "word", "d", "x"), (9, "word", "d", "x"), (None, "word", "d", "x"), (None, None, None, None), (10, "ab" * 400, "é", "x"),
    (11, PASSAGE, "a", "x"), (12, PASSAGE, "a", "x"), (13, "l one\nl one\nl two\n\nl one", "a", "x"), (14, prose(90) + " end", "a", "x"),
]
ROWS.append((15, ROWS[-1][1] + " more", "a", "x"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string, tag string").withColumns({"row": F.lit(1), "score": F.lit("s"), "anchor": F.lit(2), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def bag(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_mixing(spark, docs, none):
    got = mixing.mix(spark, mixing.sizes(docs), 16).collect()
    size = collections.Counter()
    for _, text, source, _ in ROWS:
        size[source] += len(WORDS.findall(text or ""))
    order = sorted((s for s in size if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        free = [s for s in order if s not in full]
        level = rest / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * size[s]]
        if not over:
            target = {s: 2 * size[s] if s in full else level * weight[s] for s in order}
            break
        full |= set(over)
    assert bag((r.doc_id, r.size) for r in got) == bag((i, len(WORDS.findall(t or ""))) for i, t, _, _ in ROWS)
    taken = collections.Counter()
    for r in got:
        assert abs(r.target - target[r.source]) < 1e-6 and r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)
    assert bag(got) == bag(mixing.mix(spark, mixing.sizes(docs.repartition(2)), 16).collect())
    assert mixing.mix(spark, mixing.sizes(none)).count() == 0
    out = mixing.take(spark, docs)
    assert out.columns == docs.columns and sum(len(WORDS.findall(r.text)) for r in out.collect()) == sum(r.taken for r in mixing.mix(spark, mixing.sizes(docs)).collect())


def test_schedule_is_spread(spark, docs):
    s = mixing.with_slots(mixing.source_targets(mixing.sizes(docs)), 8)
    rows = mixing.schedule(spark, s, 8).orderBy("slot").collect()
    quota = {(r.has_source, r.source): r.slots for r in s.collect() if r.slots}
    assert collections.Counter((r.has_source, r.source) for r in rows) == quota
    half = collections.Counter((r.has_source, r.source) for r in rows[: len(rows) // 2])
    assert all(abs(half[k] - n / 2) <= 6 for k, n in quota.items())


def test_quality_rules(spark, docs, none):
    def count(text):
        words = WORDS.findall(text or "")
        wins = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = collections.Counter(wins)
        covered = {j for i, w in enumerate(wins) if n[w] > 1 for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
        return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)

    plan = quality_rules.plan_cascade(spark, docs)
    assert {x.name for x in plan} == set(quality_rules.RULES) and all(0 <= x.rejects <= 1 and x.seconds > 0 for x in plan)
    got = quality_rules.apply(docs, plan).collect()
    assert bag((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == bag((i, *count(t)) for i, t, _, _ in ROWS)
    assert all(r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed) for r in got)
    back = quality_rules.apply(docs, plan[::-1]).collect()
    assert bag((r.doc_id, r.kept) for r in got) == bag((r.doc_id, r.kept) for r in back)
    assert bag((r.doc_id, r.kept) for r in got) == bag((r.doc_id, r.kept) for r in quality_rules.verdicts(spark, docs).collect())
    assert quality_rules.apply(none, quality_rules.plan_cascade(spark, none)).filter("kept").count() == 0


def test_rules_are_ordered_by_what_is_left(spark):
    """Two rules reject the same half and a third one a quarter of the rest: after the cheaper of the two, the other has nothing left."""
    texts = spark.range(400).select(F.col("id").cast("string").alias("text"), "id")
    same = lambda m: m["id"] % 2 == 0
    dear = lambda m: (m["id"] % 2 == 0) & (F.length(F.repeat(F.sha2(F.col("text"), 512), 2000)) > 0)
    plan = quality_rules.plan(texts, {"dear": dear, "same": same, "rest": lambda m: m["id"] % 8 == 1}, {"id": F.col("id")})
    at = {x.name: (k, x.rejects) for k, x in enumerate(plan)}
    assert at["dear"][0] > at["same"][0] and at["dear"][1] == 0 and at["same"][1] in (0.5, 200 / 350)


def test_token_files(spark, docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    manifest = token_files.write_tokens(spark, docs, path, fresh_dir(spark, "t"))
    got = sorted(token_files.document_digests(manifest).collect(), key=lambda r: r.start)
    want = bag((i, len(ids := [*tok.encode(t or "", add_special_tokens=False).ids, 2]), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t, _, _ in ROWS)
    assert bag((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()
    assert [r.doc_id or -1 for r in got] == sorted(r.doc_id or -1 for r in got)
    first = manifest.orderBy("part").first()
    ids, mask = token_files.sequence(token_files.open_arrow(first.path), 0)
    assert len(ids) == token_files.LENGTH and mask.sum() == min(first.tokens, token_files.LENGTH)
    assert token_files.document_digests(token_files.write_tokens(spark, none, path, fresh_dir(spark, "t"))).count() == 0
    odd = ["a\x1cb\x85c", "Σας ΟΔΟΣ", "é é", "İx", "<|endoftext|> x", "word'. 's don't", "ﬁ²Ⅷ", "x" * 300]
    assert [x.tolist() for x in token_files.ChunkEncoder(path).encode(odd, 2)] == [[*tok.encode(t, add_special_tokens=False).ids, 2] for t in odd]


def test_simhash(spark, docs, none):
    def fp(text):
        w = WORDS.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
        h = [xxhash.xxh64_intdigest(s, seed=42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    got = simhash.components(spark, docs).select("doc_id", simhash.hex_of("fp"), "component_id").collect()
    prints = [fp(t) for _, t, _, _ in ROWS]
    group = list(range(len(ROWS)))
    for _ in ROWS:
        group = [min(group[j] for j in range(len(ROWS)) if (prints[i] ^ prints[j]).bit_count() <= 3) for i in range(len(ROWS))]
    least = {g: min((ROWS[i][0] for i in range(len(ROWS)) if group[i] == g and ROWS[i][0] is not None), default=None) for g in group}
    assert bag(got) == bag((ROWS[i][0], f"{prints[i]:016x}", least[group[i]]) for i in range(len(ROWS)))
    assert simhash.components(spark, none).count() == 0
    kept = simhash.keep_first(spark, docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {1, 2, 5, 7} and kept.filter("doc_id = 9").count() == 0


def test_pigeonhole_finds_all(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 60, dtype=np.uint64)
    fps = [int(b) for b in base]
    for b in base:
        for _ in range(40):
            fps.append(int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = np.unique(np.array(fps, np.uint64))
    nodes = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for m in (2, 3, 4):
        parts = simhash.partition_bits(simhash.correlations(nodes, len(fps)), m)
        assert sorted(sum(parts, [])) == list(range(64))
        for tau in (simhash.thresholds(fps, fps[:100], len(fps), parts),):
            assert (tau.sum(1) == 3 - m + 1).all() and (tau >= -1).all()
        root = {r.node: r.root for r in roots(spark, simhash.links(simhash.probe_rows(nodes, fps[:50], len(fps), parts), block=16)).collect()}
        want = list(range(len(fps)))
        near = [np.flatnonzero(np.bitwise_count(fps ^ x) <= 3) for x in fps]
        for _ in range(30):
            want = [min(want[j] for j in n) for n in near]
        signed = fps.view(np.int64).tolist()
        same = collections.defaultdict(set)
        for i, x in enumerate(signed):
            same[want[i]].add(root.get(x, x))
        assert all(len(v) == 1 for v in same.values()) and len(set.union(*same.values())) == len(same)


def test_suffix_collection():
    rng = random.Random(2)
    for _ in range(40):
        s = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(1, 6))]
        common, string, at = suffix_dedup.Collection(s).build()
        want = sorted(x[i:] for x in s for i in range(len(x)))
        assert [s[a][b:] for a, b in zip(string, at, strict=True)] == want
        lcp = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert common.tolist() == [0, *[lcp(a, b) for a, b in zip(want, want[1:])]]


def brute_repeats(texts):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(d[i : i + 200] for d in data for i in range(len(d) - 199))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = 1
        out.append((len(d), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(d, gone) if not g)).hexdigest()))
    return out


def test_suffix_dedup(spark, docs, none, monkeypatch):
    got = suffix_dedup.removed(spark, docs).collect()
    want = brute_repeats([r[1] for r in ROWS])
    assert bag(got) == bag((ROWS[k][0], *w) for k, w in enumerate(want)) and sum(w[1] for w in want) > 1000
    assert suffix_dedup.removed(spark, none).count() == 0
    out = suffix_dedup.strip(spark, docs)
    assert out.columns == docs.columns and {1, 7, 8} <= {r.doc_id for r in out.collect()} and not {11, 12} & {r.doc_id for r in out.collect()}


def test_suffix_dedup_shared_ids(spark):
    """Rows of one id (or none) with different texts, some of which occur elsewhere."""
    rng = random.Random(8)
    made = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(150, 700))) for _ in range(40)]
    texts = [*made, *made[:6], *made[:3], made[7][:450] + made[9], "x" + made[11]]
    rows = [(k % 3 or None, t) for k, t in enumerate(texts)]
    rows += rows[:2] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = bag((i, *w) for (i, _), w in zip(rows, brute_repeats([t for _, t in rows]), strict=True))
    assert bag(suffix_dedup.removed(spark, docs).collect()) == want
    kept = collections.Counter(r.text for r in suffix_dedup.strip(spark, docs).collect())
    assert all(kept[t] == 1 for t in made[12:])


def test_suffix_dedup_blocks():
    """An anchor that is taken apart makes a row of a block, not of a window: each window is in one, and equal windows are in blocks of one piece."""
    rng = np.random.default_rng(5)
    texts = [bytes(rng.integers(97, 123, 160, np.uint8)) + b"the line that is in every document of them, word by word " * 2 + bytes(rng.integers(97, 123, 160, np.uint8)) for _ in range(20)]
    texts += [t[20:-7] for t in texts]
    rows, windows, pieces = 0, 0, {}
    for text in texts:
        data = np.frombuffer(text, np.uint8)
        for start, n, anchor, _ in zip(*(x.tolist() for x in suffix_dedup.runs_of(data)), strict=True):
            one = text[start : start + n + suffix_dedup.LENGTH - 1]
            made = list(suffix_dedup.blocks_of(one, int(np.uint64(anchor).view(np.int64))))
            assert [w for _, _, _, a, b, _ in made for w in range(a, b + 1)] == list(range(n)) and all(len(h) == b + 1 - a for *_, a, b, h in made)
            rows, windows = rows + len(made), windows + n
            for piece, _, _, a, b, _ in made:
                for w in range(a, b + 1):
                    pieces.setdefault(one[w : w + suffix_dedup.LENGTH], set()).add(piece)
    assert rows * 4 < windows and all(len(p) == 1 for p in pieces.values()) and len(pieces) < windows


@pytest.mark.parametrize("hot", [3, 1024])
def test_suffix_dedup_hot_anchor(spark, hot):
    """A phrase in very many different surroundings, long and short of the window's length: taken apart or not, the same bytes go."""
    rng = random.Random(9)
    say = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrases, shared = [say(60), say(190), say(230), say(500)], say(130)
    texts = [say(rng.randint(0, 200)) + p + (shared if k % 5 == 0 else "") + say(rng.randint(0, 200)) for k in range(40) for p in phrases]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = docs.join(suffix_dedup.spans(spark, docs, hot), suffix_dedup.text_key(F.col("text")) == F.col("key"), "left").select("doc_id", "text", "spans")
    found = found.mapInArrow(suffix_dedup._digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert bag(found.collect()) == bag((k, *w) for k, w in enumerate(brute_repeats(texts)))


def test_compare_partial_overlaps():
    rng = random.Random(4)
    text = bytes(rng.choice(b"abcdefgh") for _ in range(700))
    strings = [text[:420], text[100:560], text[230:], b"z" * 30 + text[300:540]]
    flags = suffix_dedup.repeated(strings)
    seen = collections.Counter(s[i : i + 200] for s in strings for i in range(len(s) - 199))
    assert all(flags[k][i] == (seen[s[i : i + 200]] > 1) for k, s in enumerate(strings) for i in range(len(s) - 199))


def test_byte_bpe(spark, docs, none):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path), path)).collect()
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert bag(got) == bag((i, len(ids := lib.encode_ordinary(t or "")), sha(",".join(map(str, ids)).encode()), sha((t or "").encode())) for i, t, _, _ in ROWS)
    odd = ["a\x1c\x85 b", "  \n x", "q" * 3000, "　é😀", "ab" * 700, ""]
    assert [x.tolist() for x in byte_bpe.RankBpe(path).encode(odd)] == [lib.encode_ordinary(t) for t in odd]
    assert byte_bpe.encode(none, path).count() == 0


def test_media(spark, docs, none):
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = media_ts.digests(media_ts.load(media_ts.store(docs))).collect()
    want = []
    for i, text, _, _ in ROWS:
        data = (text or "").encode()
        p = media_ts.padded(data)
        m = media_ts.mux(p)
        found = media_ts.demux(m)
        pts = found["pts"]
        feature = f"type=6;packets={len(m) // 188};units={len(pts)};pts={pts[0]}-{pts[-1]};rap=" + ",".join(f"{k}@{pts[k]}" for k in found["rap"])
        want.append((i, len(data), len(p), sha(p), zlib.crc32(p[-32:]), len(m), sha(m), feature))
    assert bag(got) == bag(want)
    rows = media_ts.load(media_ts.store(docs)).collect()
    assert bag(r.payload for r in rows) == bag(media_ts.padded((t or "").encode()) for _, t, _, _ in ROWS) and all(r.pts == [9000 + 3600 * k for k in range(len(r.pts))] and r.random_access == list(range(0, len(r.pts), media_ts.GROUP)) for r in rows)
    assert media_ts.digests(media_ts.load(media_ts.store(none))).count() == 0
    for n in (576, 11520, 11521 + 575, 576 * 300):
        data = random.Random(n).randbytes(n)
        found = media_ts.demux(media_ts.mux(data))
        assert found["payload"] == data and len(found["pts"]) == -(-n // media_ts.UNIT) and found["rap"] == list(range(0, len(found["pts"]), media_ts.GROUP))
    broken = bytearray(media_ts.mux(b"x" * 5760))
    broken[188 * 4 + 3] ^= 1
    with pytest.raises(ValueError, match="continuity"):
        media_ts.demux(bytes(broken))


def test_media_of_others():
    """A network entry before the program, a program map that spans packets, and elementary packets of open length."""
    pat = media_ts._section(0, 1, (0).to_bytes(2, "big") + (0xE010).to_bytes(2, "big") + (3).to_bytes(2, "big") + (0xE000 | 0x500).to_bytes(2, "big"))
    streams = b"".join(bytes([6]) + (0xE000 | media_ts.PID_ES + k).to_bytes(2, "big") + b"\xf0\x06" + b"\x05\x04TEST" for k in range(30))
    pmt = b"\x00" + media_ts._section(2, 3, (0xE000 | media_ts.PID_ES).to_bytes(2, "big") + b"\xf0\x00" + streams)
    maps = [b"\x47" + ((0x4000 if k == 0 else 0) | 0x500).to_bytes(2, "big") + bytes([0x10 | k]) + pmt[at : at + 184].ljust(184, b"\xff") for k, at in enumerate(range(0, len(pmt), 184))]
    data = random.Random(1).randbytes(5760)
    own = bytearray(media_ts.mux(data)[2 * 188 :])
    at = own.index(b"\x00\x00\x01\xbd") + 4
    own[at : at + 2] = b"\x00\x00"
    found = media_ts.demux(media_ts._table_packet(0, pat, 0) + b"".join(maps) + bytes(own))
    assert len(maps) == 2 and found["payload"] == data and found["stream_type"] == 6
    with pytest.raises(ValueError, match="bad section"):
        media_ts.demux(media_ts._table_packet(0, pat, 0) + maps[0] + bytes(own))


def test_warc(spark):
    page = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "http://a/\r\nb", page), (2, None, page), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (None, "u", page), (7, "u", "é" * 5000), (2, "u", page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    manifest = warc.write_archives(spark, pages, fresh_dir(spark, "w"))
    want = bag((i, len((h or "").encode()), hashlib.sha256((h or "").encode()).hexdigest(), *(("revisit", 1) if h == page and i != 1 else ("response", None))) for i, _, h in rows)
    for split in (50, 333, 1 << 20):
        assert bag(warc.read_archives(manifest, split).drop("url").collect()) == want
    assert warc.read_archives(warc.write_archives(spark, pages.limit(0), fresh_dir(spark, "w"))).count() == 0


def test_quality_qda(spark, docs, none):
    rng = random.Random(1)
    good = [(k, " ".join(rng.choice(["wald", "haus", "rot", "grün", "lauf"]) for _ in range(60)) + ".", 1) for k in range(300)]
    bad = [(1000 + k, " ".join(rng.choice(["WALD!!", "x$$$", "|", "###"]) for _ in range(60)), 0) for k in range(100)]
    table = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality_qda.train(table, table.select("doc_id", "quality"))
    rows = quality_qda.scored(table, model).collect()
    assert sum((r.score >= 0.7) == (r.quality == 1) for r in rows) >= 0.99 * len(rows)
    got = quality_qda.scored(docs, model)
    assert got.columns == [*docs.columns, "_score"] and all(0 <= r._score <= 1 and r.score == "s" for r in got.collect())
    kept = quality_qda.keep(spark, docs, table.select("doc_id", "quality"))
    assert kept.columns == docs.columns and quality_qda.keep(spark, none, table.select("doc_id", "quality")).count() == 0
    odd = table.select("doc_id", F.lit(2).alias("quality")).unionAll(table.select("doc_id", F.lit(None).cast("int")))
    assert {r.score for r in quality_qda.scored(table, quality_qda.train(table, odd)).collect()} == {1.0}
    assert quality_qda.train(none, table.select("doc_id", "quality")).score(np.zeros((2, quality_qda.N_STATISTICS))).tolist() == [1.0, 1.0]


def test_quality_qda_is_the_density(spark):
    """Scores against the two normal densities written out with determinants and inverses, and the shrinkage with loops."""
    rng = np.random.default_rng(3)
    d = quality_qda.N_STATISTICS
    x = np.concatenate([rng.normal(0, 1, (70, d)) @ rng.normal(0, 1, (d, d)), rng.normal(1, 2, (40, d))])
    y = np.array([0] * 70 + [1] * 40)
    model = quality_qda.fit(x, y)
    z = quality_qda.CLIP * np.tanh((x - x.mean(0)) / x.std(0) / quality_qda.CLIP)
    log = []
    for c in (0, 1):
        own = z[y == c]
        n, mean = len(own), own.mean(0)
        above = below = 0.0
        for i in range(d):
            for j in range(d):
                if i != j:
                    w = (own[:, i] - mean[i]) * (own[:, j] - mean[j])
                    above += ((w - w.mean()) ** 2).sum() / (n - 1) ** 2
                    below += (w.sum() / (n - 1)) ** 2
        shrink = min(1.0, max(quality_qda.SHRINK, above / below))
        assert abs(shrink - quality_qda.shrinkage(own)) < 1e-9
        cov = (1 - shrink) * np.cov(own.T) + shrink * np.diag(z.var(0)) + quality_qda.FLOOR * np.eye(d)
        far = np.array([(v - mean) @ np.linalg.inv(cov) @ (v - mean) for v in z])
        log.append(np.log(n / len(z)) - 0.5 * (far + np.log(np.linalg.det(cov))))
    assert np.allclose(model.score(x), 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500))), atol=1e-8)


def test_lexicon_is_the_naive_search(docs):
    """Sums of weights against a search of every entry at every place, exception phrases left out."""
    rng = random.Random(6)
    entries = tuple((p, rng.random()) for p in (" gru", " bad ", " ba", "ash", " trash ", " zwo", " naiv"))
    lexicon = toxicity.Lexicon(entries, (0.0, 1.0, 1.0), ("trash can", "bad luck"))
    say = lambda: " ".join(rng.choice(["grumpf", "bad", "luck", "trash", "can", "b4d", "bás", "Zwölf", "NAÏVE", "tr@sh", "x", "gruppe,can"]) for _ in range(rng.randint(0, 30)))
    for text in [*(say() for _ in range(200)), "", " \n", *[r[1] or "" for r in ROWS]]:
        folded = toxicity.fold(text)
        spared = {k for phrase in lexicon.exceptions for at in range(len(folded)) if folded.startswith(f" {phrase} ", at) for k in range(at, at + len(phrase) + 2)}
        spans = [(at, at + len(p), w) for p, w in entries for at in range(len(folded)) if folded.startswith(p, at)]
        phrases = [(at, at + len(q) + 2) for q in lexicon.exceptions for at in range(len(folded)) if folded.startswith(f" {q} ", at)]
        total = sum(w for a, b, w in spans if not any(x <= a and b <= y for x, y in phrases))
        assert np.allclose(lexicon.statistics([text])[0], np.log1p([total, len(folded.split())])) and (spared or not phrases)


def test_toxicity_awkward_rows(spark, docs, none):
    lexicon = toxicity.Lexicon(((" word", 2.0),), (-1.0, 2.0, -0.5))
    got = toxicity.scored(docs, lexicon)
    assert got.columns == [*docs.columns, "_score"] and got.count() == len(ROWS)
    by = collections.defaultdict(set)
    for r in got.collect():
        assert 0 <= r._score <= 1 and r.score == "s"
        by[r.text].add(r._score)
    assert all(len(v) == 1 for v in by.values()) and toxicity.scored(none, lexicon).count() == 0
    odd = docs.select("doc_id", F.lit(2).alias("toxic")).unionAll(docs.select("doc_id", F.lit(None).cast("int")))
    assert toxicity.train(docs, odd).score(["word"]).tolist() == [0.0]


def test_toxicity(spark, none):
    rng = random.Random(1)
    say = lambda n: [rng.choice(["wald", "haus", "rot", "lauf", "baum", "stein", "fluss"]) + str(rng.randint(1, 40)) for _ in range(n)]
    rows = []
    for k in range(600):
        words = say(40)
        if k % 3 == 0:
            words[rng.randint(0, 39)] = "grumpf" + rng.choice(["en", "er", "isch", "te", "a", "o", "el"])
        rows.append((k, " ".join(words), int(k % 3 == 0)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lexicon = toxicity.train(table, table.select("doc_id", "toxic"))
    assert any(" grumpf".startswith(e) or e.startswith(" grumpf") for e, _ in lexicon.entries)
    score = lexicon.score(["wald haus grumpfneu rot", "wald grumрf3n rot haus", "wald haus rot", "", "trash can wald"])
    assert score[0] > 0.5 and score[1] > 0.5 and (score[2:] < 0.5).all()
    assert toxicity.fold("Grуmpf 1d10t!! ID10T") == " grympf idiot idiot "
    assert toxicity.train(none, table.select("doc_id", "toxic")).score(["x"]).tolist() == [0.0]
