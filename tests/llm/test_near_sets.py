"""The pipeline's near duplicates against all pairs: planted copies with edits of many degrees, a large group, nulls and empty texts."""

import itertools
import random
import tracemalloc

import corpus_pipeline
import numpy as np
import public_tokenizers
import pyarrow as pa

from threadloom.llm import byte_bpe, near_sets, simhash

RNG = random.Random(5)
COMMON = " ".join(f"common{k}" for k in range(12))


def prose(n):
    return [f"w{RNG.randint(0, 30000)}" for _ in range(n)]


def edited(words, edits):
    out = list(words)
    for at in RNG.sample(range(len(out)), edits):
        out[at] = f"edit{RNG.randint(0, 10**9)}"
    return out


def rows():
    texts = [" ".join(prose(n)) + " " + COMMON for n in (20, 60, 150, 150)]
    for n in (40, 120, 300):
        for edits in range(0, 9 * n // 120 + 2):
            base = prose(n)
            texts += [" ".join(base), " ".join(edited(base, edits))]
    base = prose(200)
    texts += [" ".join(edited(base, 2 + k % 4)) for k in range(60)]
    texts += [None, "", " \n", "one", "ONE", "one two", *[" ".join(prose(30)) for _ in range(10)]]
    ids = list(range(len(texts)))
    RNG.shuffle(ids)
    return [*zip(ids, texts, strict=True), (None, " ".join(base)), (None, None)]


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute(made):
    sets, root = [grams(t) for _, t in made], list(range(len(made)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(range(len(made)), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both):
            root[top(a)] = top(b)
    least = {}
    for k, (i, _) in enumerate(made):
        if i is not None:
            least[top(k)] = min(i, least.get(top(k), i))
    return {i: least[top(k)] for k, (i, _) in enumerate(made) if i is not None}


def test_near_duplicates(spark):
    made = rows()
    docs = spark.createDataFrame(made, "doc_id long, text string")
    want = brute(made)
    got = {r.doc_id: r.component_id for r in near_sets.components(spark, docs).collect() if r.doc_id is not None}
    assert got == want
    kept = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(i for i in kept if i is not None) == sorted(set(want.values())) and kept.count(None) == 2
    assert near_sets.components(spark, docs.limit(0)).count() == 0


def test_blocks(spark):
    """Groups return forests: with every shingle cut into blocks or not, what they link are the components of all pairs."""
    rows = [(s, n, 10 + n % 3, 70, n % 35) for s in (1, 2) for n in range(70)]
    met = spark.createDataFrame(rows, "shingle long, node long, size int, n long, comp long")
    own = lambda n: near_sets.sketch(np.arange(n % 7 * 40, n % 7 * 40 + 10 + n % 3, dtype=np.uint64))
    nodes = spark.createDataFrame([(n, bytearray(own(n))) for n in range(70)], "node long, sketch binary")
    none = spark.createDataFrame([], "u long, v long")
    for block in (8, 1024):
        got = [tuple(r) for r in near_sets.others(met, nodes, none, block).collect()]
        assert len(got) <= 2 * 35 * max(1, 70 // block) ** 2 and all(u % 7 == v % 7 for u, v, _ in got)
        root = list(range(35))
        for u, v, _ in got:
            a, b = root[u % 35], root[v % 35]
            root = [a if x == b else x for x in root]
        assert len(set(root)) == 7
        left = near_sets.others(met, nodes, spark.createDataFrame([g[:2] for g in got], "u long, v long"), block).collect()
        assert not {g[:2] for g in got} & {tuple(r)[:2] for r in left}


def test_forest_memory():
    """Rows of one group that may all be linked: a spanning forest for each depth, and no list of all pairs."""
    n = 900
    zero, ids = np.zeros(n, np.int64), np.arange(n, dtype=np.int64)
    sketches = np.ones((n, near_sets.CLASSES), np.uint8)
    for depth in (1, 3):
        tracemalloc.start()
        x, y = near_sets.forest(near_sets.candidates(zero, ids, zero + 100, ids, zero, zero, sketches), zero, ids, ids, set(), depth)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(x) == len(set(zip(x, y, strict=True))) == depth * (n - 1) and peak < 20 << 20


def test_failed_pairs_memory():
    """Rows of nodes that failed with many others: pairs among the rows' own nodes are left out, and the lists become no Python objects."""
    n, shingles, far = 100, 8, 2000
    node = np.tile(np.arange(n, dtype=np.int64), shingles)
    shingle = np.repeat(np.arange(shingles, dtype=np.int64), n)
    zero, fails = np.zeros(n * shingles, np.int32), [[*range(10**6, 10**6 + far), *([1] if k == 0 else [0] if k == 1 else [])] for k in range(n)]
    lists = pa.array(fails, pa.list_(pa.int64())).take(pa.array(node))
    columns = {"shingle": shingle, "i": zero, "j": zero, "node": node, "size": zero + 100, "comp": node, "own": zero, "sketch": pa.array([bytes([1] * near_sets.CLASSES)] * len(node), pa.binary()), "failed": lists}
    batch = pa.record_batch({k: pa.array(v) if isinstance(v, np.ndarray) else v for k, v in columns.items()})
    tracemalloc.start()
    (got,) = near_sets._pairs(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pairs = set(zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True))
    assert (0, 1) not in pairs and {k for p in pairs for k in p} == set(range(n)) and peak < 20 << 20


def test_texts_of(spark):
    """Texts of the wanted, one row each, broadcast or not; where they are few, no other text is dealt out."""
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (3, "c"), (4, None), (5, "d")], "doc_id long, text string")
    hashes = {r.text: r.text_hash for r in near_sets._with_hash(docs).collect()}
    wanted = spark.createDataFrame([(10, hashes["a b"]), (11, hashes[""])], "node long, text_hash long")
    plans = []
    for few in (True, False):
        texts = near_sets.texts_of(docs, wanted, few)
        assert sorted(map(tuple, texts.collect())) == [(10, "a b"), (11, "")]
        plans.append(texts._jdf.queryExecution().optimizedPlan().toString())
    assert ["LeftSemi" in p for p in plans] == [True, False]


def test_tokens_in_one_step(spark):
    """The last stage starts one worker for a task, with what two steps give."""
    docs = spark.createDataFrame([(1, "Some words, 123 and more words"), (2, None), (None, ""), (4, "x" * 700 + " \u00e9\n")], "doc_id long, text string")
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    got = corpus_pipeline.tokens(spark, docs, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = byte_bpe.digests(byte_bpe.decode(byte_bpe.encode(docs, path), path), "ids")
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_rows(spark, monkeypatch):
    """Those that go are broadcast where they are few, whatever Spark would broadcast by itself; both ways give the same rows."""
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (2, "a"), (3, "b"), (3, "b"), (None, "a"), (None, "c")], "doc_id int, _own_id string")
    found = spark.createDataFrame([(1, 1), (2, 1), (2, 1), (3, 3), (3, 3), (None, 1), (None, None)], "doc_id long, component_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few, join in ((10, "BroadcastHashJoin"), (0, "SortMergeJoin")):
            monkeypatch.setattr(simhash, "FEW", few)
            out = simhash.first_rows(spark, docs, found)
            assert join in out._jdf.queryExecution().executedPlan().toString() and out.columns == docs.columns
            assert sorted(map(str, out.collect())) == sorted(map(str, [docs.limit(1).collect()[0], *docs.filter("doc_id = 3").limit(1).collect(), *docs.filter("doc_id IS NULL").collect()]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
