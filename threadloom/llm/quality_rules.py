"""Quality rules as a short-circuit cascade (operator 2), DataFrame functions only.

Measures of the whole text are words, code points in words, symbols, repeated lines,
and words in 5-word windows that the text holds twice or more. Windows are compared
by their 64-bit hash inside the row (sorted with their positions, so the work is
n log n and nothing is shuffled).

``RULES`` are applied as one CASE expression, which stops at the first rule that
rejects. Their order comes from a bounded sample, drawn over the whole frame: rules
are timed on it, and the next rule is always the one that rejects most, of what the
rules before it let pass, for its time. The order decides only how much is evaluated,
never the verdict. ``verdicts`` leaves the measures inside the CASE, so a text that an
early rule rejects is spared the dear ones; ``apply`` gives all measures of every row
and cannot spare any.

Nulls: a null text has no words, all counts zero, and fails the base rule. A null
doc_id stays null; repeated rows give equal rows; further columns are not read, so
their names may clash. An empty table gives no rows (the rules keep their order). A
text is measured whole, within one row, in memory linear in its length.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD_PATTERN, discard, materialize, table

#: Rows of the sample, at about; how often it is run through for a time; runs, of which the shortest counts; seed of the draw.
SAMPLE_ROWS, REPEATS, RUNS, SEED = 500, 4, 2, 7
WINDOW = 5

Measures = dict[str, Column]


def n_repeat_words(h: Column) -> Column:
    """Words in windows that an array of words' hashes holds twice or more."""
    get = F.get
    # each step is bound once, as the only element of an array: what a lambda refers to is then a value, not worked out again
    bind = lambda value, body: get(F.transform(F.array(value), body), F.lit(0))

    def windows(v: Column) -> Column:
        places = F.when(F.size(v) >= WINDOW, F.sequence(F.lit(0), F.size(v) - WINDOW)).otherwise(F.array().cast("array<int>"))
        return F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(*[get(v, i + k) for k in range(WINDOW)]).alias("w"), i.alias("at"))))

    def covered(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(get(s, k - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(get(s, k + 1)["w"] == x["w"], F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    def words(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(get(at, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    return bind(h, lambda v: bind(windows(v), lambda s: bind(covered(s), words))).cast("long")


def hashes(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0), lambda w: F.xxhash64(w))


def full_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def measures(text: Column) -> Measures:
    """Expressions over a text (not null), each by itself."""
    lines, long = full_lines(text), lambda c: c.cast("long")
    return {
        "n_words": long(F.regexp_count(text, F.lit(WORD_PATTERN))), "word_chars": long(F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", F.lit("")))),
        "n_symbols": long(F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", F.lit("")))), "n_lines": long(F.size(lines)), "n_dup_lines": long(F.size(lines) - F.size(F.array_distinct(lines))),
        "n_repeat_words": n_repeat_words(hashes(text)), "n_upper": F.length(F.regexp_replace(text, "[^A-Z]+", F.lit(""))), "n_lower": F.length(F.regexp_replace(text, "[^a-z]+", F.lit(""))),
        "n_lettered": F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*")),
    }


#: Whether a text is rejected, by rule, from its measures.
RULES: dict[str, Callable[[Measures], Column]] = {
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 15 * m["n_words"]),
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "duplicate_lines": lambda m: (m["n_dup_lines"] >= 3) & (10 * m["n_dup_lines"] > 3 * m["n_lines"]),
    "capitals": lambda m: m["n_upper"] > m["n_lower"],
    "few_letters": lambda m: 10 * m["n_lettered"] < 5 * m["n_words"],
}
#: The contract's own rule, always first where the measures are given; its parts are rules like others where they are not.
BASE: dict[str, Callable[[Measures], Column]] = {"few_words": lambda m: m["n_words"] < 10, "repeats": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]}
OUTPUT = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and the measures of OUTPUT, which share the words' hashes and the lines."""
    df = docs.select(F.col("doc_id"), _text().alias("text"))
    df = df.select("*", hashes(F.col("text")).alias("h"), full_lines(F.col("text")).alias("lines"))
    shared = {"n_words": F.size("h"), "n_lines": F.size("lines"), "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": n_repeat_words(F.col("h"))}
    made = measures(F.col("text")) | shared
    # a Generate, so that no later filter is pushed below it with these expressions written out inside one another
    return df.select("doc_id", "text", F.inline(F.array(F.struct(*[made[k].cast("long").alias(k) for k in OUTPUT]))))


def _given() -> Measures:
    """Measures of ``counts`` as columns, and the rest as expressions over its text."""
    return measures(F.col("text")) | {k: F.col(k) for k in OUTPUT}


def base_failed(m: Measures | None = None) -> Column:
    m = _given() if m is None else m
    return BASE["few_words"](m) | BASE["repeats"](m)


@dataclass(frozen=True)
class Step:
    """A rule of the cascade, with what the sample showed: the share that it rejects of what came to it, and seconds for the sample."""

    name: str
    rejects: float
    seconds: float


def sample(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About so many of the frame's texts, drawn over all of it with a fixed seed, written out."""
    n = docs.count()
    some = docs.select(_text().alias("text")).sample(min(1.0, rows / max(1, n)), seed=SEED).limit(4 * rows)
    return materialize(spark, some.filter(F.length("text") >= 0), "rules-sample")


def plan(texts: DataFrame, rules: dict[str, Callable[[Measures], Column]], m: Measures) -> list[Step]:
    """The rules by rejection of what is left for their time, both from a sample (with the columns that m refers to)."""
    patterns = texts.groupBy(*[r(m).alias(k) for k, r in rules.items()]).count().collect()  # at most 2 ** rules rows
    many = texts.withColumn("_again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def seconds(rejects: Column | None) -> float:
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            (many if rejects is None else many.filter(rejects)).agg(F.count(F.lit(1))).collect()
            took.append(time.perf_counter() - began)
        return min(took)

    idle = seconds(None)
    cost = {k: max(1e-4, seconds(r(m)) - idle) for k, r in rules.items()}
    out, left = [], [(r.asDict(), r["count"]) for r in patterns]
    while len(out) < len(rules):
        total = sum(n for _, n in left)
        share = {k: sum(n for p, n in left if p[k]) / max(1, total) for k in rules if k not in {s.name for s in out}}
        best = max(sorted(share), key=lambda k: share[k] / cost[k])
        out.append(Step(best, share[best], cost[best]))
        left = [(p, n) for p, n in left if not p[best]]
    return out


def plan_cascade(spark: SparkSession, docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[Step]:
    """The order of RULES behind the base rule, for rows that have their measures."""
    drawn = sample(spark, docs, rows)
    measured = materialize(spark, counts(drawn.withColumn("doc_id", F.lit(0))), "rules-measured")
    try:
        return plan(measured.filter(~base_failed()), RULES, _given())
    finally:
        discard(drawn, measured)


def apply(docs: DataFrame, cascade: list[Step]) -> DataFrame:
    """Counts, base_failed, kept and rejected_by (the first rule of the cascade that rejects) of every row."""
    m = _given()
    df = counts(docs).withColumn("base_failed", base_failed())
    first = F.when(F.col("base_failed"), F.lit("base"))
    for step in cascade:
        first = first.when(RULES[step.name](m), F.lit(step.name))
    return df.withColumn("rejected_by", first).withColumn("kept", F.col("rejected_by").isNull()).drop("text")


def verdicts(spark: SparkSession, docs: DataFrame, cascade: list[Step] | None = None) -> DataFrame:
    """doc_id, rejected_by and kept of every row, with every rule's measures inside its branch: what an early rule rejects costs no more."""
    rules = BASE | RULES
    if cascade is None:
        drawn = sample(spark, docs)
        cascade = plan(drawn, rules, measures(F.col("text")))
        discard(drawn)
    m, first = measures(F.col("text")), F.when(F.lit(False), F.lit(""))
    for step in cascade:
        first = first.when(rules[step.name](m), F.lit(step.name))
    return docs.select("doc_id", _text().alias("text")).select("doc_id", first.alias("rejected_by")).withColumn("kept", F.col("rejected_by").isNull())


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return apply(docs, plan_cascade(spark, docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op2_quality_rules": op2_quality_rules}
ORACLES = {
    "op2_quality_rules": r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents
), w as (
  select r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d
), e as (
  select r, unnest(ws) as word, generate_subscripts(ws, 1) as i from w
), g as (
  select r, i, word || ' ' || lead(word, 1) over o || ' ' || lead(word, 2) over o || ' ' || lead(word, 3) over o || ' ' || lead(word, 4) over o as win
  from e window o as (partition by r order by i)
), t as (
  select r, i from (select r, i, count(*) over (partition by r, win) as n from g where win is not null) where n > 1
), cov as (
  select r, sum(step) as n from (select r, least(5, coalesce(lead(i) over (partition by r order by i) - i, 5)) as step from t) group by r
), b as (
  select w.doc_id, w.text, len(ws)::bigint as n_words,
    length(regexp_replace(w.text, '[\x20\x09-\x0D]+', '', 'g')) as word_chars,
    length(regexp_replace(w.text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(cov.n, 0)::bigint as n_repeat_words
  from w left join cov using (r)
), f as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from b
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 2 * n_words or word_chars > 15 * n_words or 10 * n_symbols > n_words
    or (n_dup_lines >= 3 and 10 * n_dup_lines > 3 * n_lines)
    or length(regexp_replace(text, '[^A-Z]+', '', 'g')) > length(regexp_replace(text, '[^a-z]+', '', 'g'))
    or 10 * len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) < 5 * n_words) as kept
from f"""
}
