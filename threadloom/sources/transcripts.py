"""Transcripts made of the driver's tables, and a generator of long ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages of the table of plain conversations."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    text = F.coalesce("text", F.lit(""))
    return c.select(F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").cast("int").alias("idx"), F.to_json(F.struct("role", text.alias("content"))).alias("message_json"))


def agent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """messages of agents at work, one history for each user of the table of events.

    Users ask (signup), agents read (view) and call a tool (click), tools answer (error: the
    latest call if k is even, else no call), agents propose (purchase: code, a dangerous
    command, prose).
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e = e.select(F.col("user_id").cast("string").alias("conv_id"), "event_id", "ts", "event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    w = W.partitionBy("conv_id").orderBy("ts", "event_id")
    e = e.withColumn("idx", F.row_number().over(w) - 1)
    e = e.withColumn("call", F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    k, s = F.col("k"), lambda c: c.cast("string")
    q = F.concat
    user = q(F.lit('{"role":"user","content":"Please fix src/mod'), s(k), F.lit("/file"), s(k % 5), F.lit('.ts and keep the API stable"}'))
    system = F.lit('{"role":"system","content":"You are careful."}')
    view = q(F.lit('{"role":"assistant","content":"Reading module '), s(k % 3), F.lit(' of docs/guide.md"}'))
    call = q(F.lit('{"role":"assistant","content":null,"tool_calls":[{"id":"c'), s(F.col("event_id")), F.lit('","type":"function","function":{"name":"read_file","arguments":"{\\"path\\":\\"src/a'), s(k % 5), F.lit('.py\\"}"}}]}'))
    answers = F.when(k % 2 == 0, q(F.lit("c"), F.coalesce(s(F.col("call")), F.lit("0")))).otherwise(q(F.lit("orphan"), s(F.col("event_id"))))
    result = q(F.lit('{"role":"tool","tool_call_id":"'), answers, F.lit('","content":"line '), s(k), F.lit("\\nerror at step "), s(k % 4), F.lit('"}'))
    code = q(F.lit('{"role":"assistant","content":"```\\ncode '), s(k % 2), F.lit('\\n```"}'))
    push = F.lit('{"role":"assistant","content":"git push --force origin main"}')
    remove = q(F.lit('{"role":"assistant","content":"rm -rf /srv/data'), s(k % 2), F.lit('"}'))
    good = q(F.lit('{"role":"assistant","content":"All good, step '), s(k % 3), F.lit('"}'))
    t = F.col("event_type")
    message = (
        F.when((t == "signup") & (k % 7 == 0), system).when(t == "signup", user).when(t == "view", view).when(t == "click", call).when(t == "error", result)
        .when(k % 4 == 0, code).when(k % 4 == 1, push).when(k % 4 == 2, good).otherwise(remove)
    )
    return e.select("conv_id", F.col("idx").cast("int").alias("idx"), message.alias("message_json"))


def generated(spark: SparkSession, histories: int, messages: int, seed: int = 1) -> DataFrame:
    """Made-up long sessions: every pick is an MD5 of seed, history and position, so any size is the same data."""
    rows = spark.range(histories * messages).select((F.col("id") / messages).cast("long").alias("h"), (F.col("id") % messages).cast("int").alias("idx"))
    pick = lambda n, salt: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("h").cast("string"), F.col("idx").cast("string"), F.lit(salt))), 1, 7), 16, 10).cast("long") % n
    act = F.pmod(F.col("idx"), F.lit(5))
    user = F.format_string('{"role":"user","content":"Ticket T-%d: check app/part%d.py, the limit must stay below %d"}', pick(9000, "t"), pick(40, "p"), pick(500, "l"))
    say = F.format_string('{"role":"assistant","content":"Looking at step %d of %d"}', pick(9, "a"), pick(20, "b"))
    call = F.format_string('{"role":"assistant","content":null,"tool_calls":[{"id":"g%d_%d","type":"function","function":{"name":"run","arguments":"{\\"cmd\\":\\"pytest app/part%d.py\\"}"}}]}', F.col("h"), F.col("idx"), pick(40, "p"))
    result = F.format_string('{"role":"tool","tool_call_id":"g%d_%d","content":"%d passed, %d failed"}', F.col("h"), F.col("idx") - 1, pick(60, "y"), pick(4, "n"))
    done = F.format_string('{"role":"assistant","content":"Done with part %d"}', pick(12, "d"))
    message = F.when(act == 0, user).when(act == 1, say).when(act == 2, call).when(act == 3, result).otherwise(done)
    return rows.select(F.concat(F.lit("g"), F.col("h").cast("string")).alias("conv_id"), "idx", message.alias("message_json"))
