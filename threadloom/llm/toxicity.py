"""Toxicity: a weighted lexicon matched by Aho-Corasick (operator 8).

Texts are folded first: compatibility forms, look-alike letters of other scripts,
lower case, and digits or signs that stand for letters inside a word (accents stay:
without them other words fall together and fewer toxic texts are found). The lexicon
is learned from labels: beginnings of words and whole words that toxic documents use
far more than others, counted by document at the word's first place in it, and once
for each context (the words beside), so copies of a text count once; the shortest
beginning that is significant stands for all words under it, which reaches forms that
no labelled row has. One automaton
finds all entries and the exception phrases in a pass; a match inside an exception
phrase doesn't count. The score is a logistic function of the log of the summed
weights and of the text's length.

Only the fit is on a sample: at most ``TRAIN_ROWS`` labelled rows of either class,
those of least hash of their id. Labels, lang, source and doc_id never enter a
score. Nulls: a null text scores as the empty one; a null doc_id is never held
out; labels other than 0 and 1 are left out. Without labels of both classes nothing is
learned and every score is 0. Repeated rows score alike; other columns are kept by
``scored``, whose new column gets underscores where its name is taken. An empty table
gives no rows. A text is taken whole, in memory linear in its length.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, table, text_rows

TRAIN_ROWS = 10_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
#: Lengths of the beginnings tried; least contexts, log-likelihood ratio and log odds of an entry.
SHORTEST, LONGEST, CONTEXTS, RATIO, ODDS = 3, 8, 8, 15.0, 3.0
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "clown fish", "sore loser", "pathetic fallacy", "scum of milk", "pond scum")
#: Look-alikes of Latin letters in Cyrillic, Greek and other blocks.
_HOMOGLYPHS = str.maketrans("авсеһіјкмнорѕтухԁԛԝαβεικνορτυχγωııℓ", "abcehijkmhopstyxdqwabeiknoptuxywiil")
_SIGNS = str.maketrans("0134579@$!", "oieastgasi")
_INSIDE = re.compile(r"(?<=[^\W\d_])[0134579@$!]+(?=[^\W\d_])|(?<![\w@$])[0134579@$]+(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")


def fold(text: str) -> str:
    """The folded words of a text, with one space before, between and after them."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text).lower().translate(_HOMOGLYPHS)
    else:
        text = text.lower()
    return " " + " ".join(_WORD.findall(_INSIDE.sub(lambda m: m[0].translate(_SIGNS), text))) + " "


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, labels, texts in text_rows(batches, ("doc_id", "label", "text"), 64):
        rows = []
        for doc_id, label, text in zip(ids, labels, texts, strict=True):
            words = fold(text or "").split()
            first = dict(zip(reversed(words), reversed(list(zip(["", *words], [*words[1:], ""], strict=False))), strict=True))
            rows += [(doc_id, label, word, f"{a} {b}") for word, (a, b) in first.items()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else ([],) * 4, (pa.int64(), pa.int32(), pa.string(), pa.string()), strict=True)], ["doc_id", "label", "word", "beside"])


@lru_cache(4)
def automaton(entries: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]) -> ahocorasick.Automaton:
    """One automaton for a worker's life: entries bring their weight, exceptions none."""
    a = ahocorasick.Automaton()
    for pattern, weight in entries:
        a.add_word(pattern, (len(pattern), weight))
    for phrase in exceptions:
        a.add_word(p := f" {phrase} ", (len(p), None))
    a.make_automaton()
    return a


@dataclass(frozen=True)
class Lexicon:
    """entries: pattern (a leading space is a word's start, a trailing one its end) and weight. beta: of 1, log1p(sum), log1p(words)."""

    entries: tuple[tuple[str, float], ...]
    beta: tuple[float, float, float] | None
    exceptions: tuple[str, ...] = EXCEPTIONS

    def statistics(self, texts: list[str]) -> np.ndarray:
        """log1p of the summed weights and of the words of each text."""
        out = np.zeros((len(texts), 2))
        a = automaton(self.entries, self.exceptions) if self.entries else None
        for k, text in enumerate(texts):
            folded = fold(text)
            out[k, 1] = folded.count(" ") - 1 if len(folded) > 2 else 0  # without a word: two spaces
            if a is None:
                continue
            hits, spared = [], []
            for end, (length, weight) in a.iter(folded):
                (spared if weight is None else hits).append((end - length + 1, end, weight))
            out[k, 0] = sum(w for s, e, w in hits if not any(x <= s and e <= y for x, y, _ in spared))
        return np.log1p(np.maximum(out, 0))

    def score(self, texts: list[str]) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(texts))
        x = self.statistics(texts)
        return 1 / (1 + np.exp(-np.clip(self.beta[0] + x @ np.array(self.beta[1:]), -500, 500)))


def choose(counts: pd.DataFrame, toxic: int, clean: int) -> tuple[tuple[str, float], ...]:
    """Shortest significant patterns with their log odds. counts: pattern, pos, neg."""
    entries: dict[str, float] = {}
    for pattern, pos, neg in sorted(counts.itertuples(index=False, name=None), key=lambda r: (len(r[0]), r[0])):
        if any(pattern[:k] in entries for k in range(1, len(pattern))):
            continue
        entries[pattern] = float(np.log((pos + 0.5) / (toxic + 1) * (clean + 1) / (neg + 0.5)))
    return tuple(entries.items())


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton steps."""
    z, beta = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    keep = ridge * len(x) * np.diag([1e-6, *[1.0] * x.shape[1]])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep + 1e-9 * np.eye(len(beta)), z.T @ (y - p) - keep @ beta)
        beta = beta + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(beta.tolist())


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Lexicon:
    """Learn from at most ``most`` labelled rows of either class that are not held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).filter(F.col("label").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % FOLDS != HELD_OUT))
    part = lambda c: known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(part(0).unionAll(part(1))), "doc_id")
    used = rows.mapInArrow(_contexts, "doc_id long, label int, word string, beside string").groupBy("word", "beside", "label").count()
    words = used.groupBy("word").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")).persist()
    try:
        total = words.agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).first()
        toxic, clean = total["pos"] or 0, total["neg"] or 0
        if not toxic or not clean:
            return Lexicon((), None)
        starts = F.expr(f"transform(sequence({SHORTEST}, {LONGEST}), k -> case when length(word) >= k then concat(' ', substring(word, 1, k)) end)")
        patterns = words.select(F.explode(F.concat(starts, F.array(F.concat(F.lit(" "), "word", F.lit(" "))))).alias("pattern"), "pos", "neg").filter("pattern is not null")
        by = patterns.groupBy("pattern").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
        share, n = toxic / (toxic + clean), F.col("pos") + F.col("neg")
        ratio = F.col("pos") * F.log(F.col("pos") / (n * share)) + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0)
        odds = F.log((F.col("pos") + 0.5) / (toxic + 1) * (clean + 1) / (F.col("neg") + 0.5))
        found = by.filter((F.col("pos") >= CONTEXTS) & (ratio >= RATIO) & (odds >= ODDS)).toPandas()  # of a bounded sample
    finally:
        words.unpersist()
    lexicon = Lexicon(choose(found, toxic, clean), None)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels_, texts in text_rows(batches, ("doc_id", "label", "text")):
            x = lexicon.statistics([t or "" for t in texts])
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(labels_, pa.int32()), pa.array(x[:, 0]), pa.array(x[:, 1])], ["doc_id", "label", "s", "n"])

    got = rows.mapInArrow(measure, "doc_id long, label int, s double, n double").orderBy("doc_id", "label", "s", "n").limit(4 * most).toPandas()
    return Lexicon(lexicon.entries, logistic(got[["s", "n"]].to_numpy(), got["label"].to_numpy(float)))


def scored(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(lexicon.score([t or "" for t in texts]))

    return docs.withColumn(free_name("score", docs.columns), score("text"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(docs, train(docs, table(spark, sf_dir, "labels")))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


QUERIES = {"op8_toxicity": op8_toxicity}
ORACLES: dict[str, str] = {}
