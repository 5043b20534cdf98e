"""Views of a run as text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.findings import per_history
from ..operators.units import kind_label

TAGS = {"kept": "KEEP", "pinned": "PIN", "flagged": "FLAG", "duplicate": "DUP", "dropped": "DROP", "budget": "DROP"}


def number(c: Column | str) -> Column:
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def summary_line(results: DataFrame) -> DataFrame:
    """conv_id and ``kept 12/40 messages · 15,231 → 6,004 tokens``, with what a judge took and cost, skips and blocks."""
    n = lambda c: F.col(c).cast("string")
    asked = [F.concat(F.lit("judge "), number("latency_ms"), F.lit(" ms")), F.concat(F.lit("$"), F.format_string("%.4f", "usd"))] if "usd" in results.columns else []
    line = F.concat_ws(
        " · ", F.concat(F.lit("kept "), n("messages_after"), F.lit("/"), n("messages_before"), F.lit(" messages")), F.concat(number("tokens_before"), F.lit(" → "), number("tokens_after"), F.lit(" tokens")),
        *[F.when(F.col("latency_ms").isNotNull(), c) for c in asked], F.concat(F.lit("skipped: "), "skipped"), F.when(F.col("blocked"), "BLOCKED"),
    )
    return results.select("conv_id", line.alias("line"))


def tag(decision: Column | str = "decision") -> Column:
    d = F.col(decision) if isinstance(decision, str) else decision
    out = F.lit("?")
    for k, v in TAGS.items():
        out = F.when(d == k, v).otherwise(out)
    return out


def index_range() -> Column:
    i = F.col("indices")
    first, last = F.get(i, F.lit(0)).cast("string"), F.element_at(i, -1).cast("string")
    return F.when(F.size(i) == 0, "#-").when(F.size(i) == 1, F.concat(F.lit("#"), first)).otherwise(F.concat(F.lit("#"), first, F.lit("-"), last))


def reason_text() -> Column:
    drop = F.col("decision").isin("dropped", "budget") & F.col("p_keep").isNotNull() & ~F.col("reason").rlike(r"\bp=")
    return F.when(drop, F.concat("reason", F.lit(" p="), F.format_string("%.2f", 1 - F.col("p_keep")))).otherwise(F.col("reason"))


#: Narrowest view, and the shortest preview worth its place.
MIN_WIDTH, MIN_PREVIEW = 40, 12


def unit_lines(units: DataFrame, width: int = 120, secret: str | None = None) -> DataFrame:
    """conv_id, unit_pos and one line per unit, columns padded to the history's widest; a preview where there is room."""
    width = max(MIN_WIDTH, width)
    df = units.select("conv_id", "unit_pos", "unit_id", tag().alias("tag"), index_range().alias("range"), kind_label().alias("kind"), number("tokens").alias("size"), reason_text().alias("why"), T.redact("text", secret).alias("text"))
    w = W.partitionBy("conv_id")
    wide = lambda c, least: F.greatest(F.lit(least), F.max(F.length(c)).over(w))
    prefix = F.concat_ws(
        "  ", F.rpad("tag", 5, " "), F.rpad(F.col("unit_id"), wide("unit_id", 2), " "), F.rpad(F.col("range"), wide("range", 2), " "), F.rpad(F.col("kind"), wide("kind", 4), " "),
        F.concat(F.lpad(F.col("size"), wide("size", 1), " "), F.lit(" tok")), F.col("why"),
    )
    df = df.withColumn("line", prefix).withColumn("room", F.lit(width) - F.length("line") - 2)
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    preview = F.when(F.length(flat) <= F.col("room"), flat).otherwise(F.concat(flat.substr(F.lit(1), F.greatest(F.lit(0), F.col("room") - 1)), F.lit("…")))
    return df.select("conv_id", "unit_pos", F.when((F.col("room") >= MIN_PREVIEW) & (flat != ""), F.concat("line", F.lit("  "), preview)).otherwise(F.col("line")).alias("line"))


def finding_text(f: Column) -> Column:
    """``  action  destructive   pattern  p=1.00  #3  evidence`` for a finding."""
    where = F.when(F.size(f["indices"]) > 0, F.concat(F.lit("#"), F.array_join(f["indices"].cast("array<string>"), ",")))
    return F.concat_ws("  ", F.lit(""), F.rpad(f["level"], 6, " "), F.rpad(f["kind"], 12, " "), F.rpad(f["source"], 7, " "), F.concat(F.lit("p="), F.format_string("%.2f", f["probability"])), where, f["evidence"])


def finding_line(findings: DataFrame) -> DataFrame:
    return findings.select("conv_id", "rank", finding_text(F.struct("level", "kind", "source", "probability", "indices", "evidence")).alias("line"))


def inspect(result, width: int = 120, secret: str | None = None) -> DataFrame:
    """conv_id, line_no and line of the whole view of each history: header, a line per unit, findings, the corrective text. A secret is taken out of all of them."""
    width, r = max(MIN_WIDTH, width), result.results
    n = result.units.groupBy("conv_id").agg(F.count(F.lit(1)).cast("string").alias("n_units"))
    head = r.join(n, "conv_id").join(summary_line(r).withColumnRenamed("line", "summary"), "conv_id")
    has_error = "error" in r.columns
    goal = F.when(F.col("goal") == "", "(none)").otherwise(T.one_line("goal", width - 9))
    lines = [
        F.concat(F.lit("goal     "), goal), F.concat(F.lit("format   "), "format", F.lit(" · "), F.col("messages_before").cast("string"), F.lit(" messages · "), "n_units", F.lit(" units")), F.concat(F.lit("result   "), "summary"),
        F.concat(F.lit("error    "), "error") if has_error else F.lit(None).cast("string"), F.when(F.col("blocked"), "blocked  yes (safety gating)"), F.lit(""),
    ]
    part = lambda df, o, c: df.select("conv_id", F.lit(o).alias("part"), F.posexplode(c).alias("at", "line"))
    rows = part(head, 0, F.filter(F.array(*lines), lambda x: x.isNotNull()))
    rows = rows.unionByName(unit_lines(result.units.filter("reason is not null"), width, secret).select("conv_id", F.lit(1).alias("part"), F.col("unit_pos").alias("at"), "line"))
    found = r.select("conv_id").join(per_history(result.findings), "conv_id", "left")
    texts = F.when(F.col("found").isNull(), F.array(F.lit(""), F.lit("findings none"))).otherwise(F.concat(F.array(F.lit(""), F.lit("findings")), F.transform("found", finding_text)))
    rows = rows.unionByName(part(found, 2, texts))
    told = F.concat(F.array(F.lit(""), F.lit("corrective")), F.transform(F.split("addendum", "\n"), lambda x: F.concat(F.lit("  "), x)))
    rows = rows.unionByName(part(r.filter("addendum is not null"), 3, told))
    return rows.select("conv_id", (F.row_number().over(W.partitionBy("conv_id").orderBy("part", "at")) - 1).alias("line_no"), T.redact("line", secret).alias("line"))


def corrective_of(kept: DataFrame, original: DataFrame) -> DataFrame:
    """Messages of a result that are not among the originals."""
    return kept.join(original.select("conv_id", "message_json"), ["conv_id", "message_json"], "left_anti")
