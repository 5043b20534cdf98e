"""``python -m threadloom compact|inspect|self-test``: exit code 0, 1 for a failure or a failed check, 2 for a blocked history."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="threadloom")
    p.add_argument("command", choices=("compact", "inspect", "self-test"))
    p.add_argument("path", nargs="?", help="a .json or .jsonl file, a folder of them, or - for standard input")
    p.add_argument("--max-tokens", type=int, default=15000)
    p.add_argument("--format", default="auto", choices=("auto", "openai", "anthropic", "langchain", "plain"))
    p.add_argument("--out", help="folder for the kept messages and results, as JSON")
    a = p.parse_args(argv)
    if a.max_tokens <= 0:
        p.error("--max-tokens is a positive number")
    from pyspark.sql import SparkSession

    from .options import Options
    from .plans import render
    from .plans.compact import compact, self_test
    from .sources import readers

    spark = SparkSession.builder.appName("threadloom").getOrCreate()
    if a.command == "self-test":
        found = self_test(spark)
        print(json.dumps(found))
        return 0 if found["ok"] else 1
    if not a.path:
        p.error("a path is needed")
    messages = readers.read_any(spark, a.path) if a.path == "-" or a.path.endswith((".json", ".jsonl")) else readers.read_folder(spark, a.path)
    got = compact(messages, Options(max_tokens=a.max_tokens, format=a.format, safety_gating=True))
    if a.out:
        readers.write_json(got.messages, f"{a.out}/messages")
        readers.write_json(got.results, f"{a.out}/results")
    lines = render.summary_line(got.results) if a.command == "compact" else render.inspect(got).orderBy("conv_id", "line_no")
    for row in lines.toLocalIterator():
        print(row["line"])
    return 2 if got.results.filter("blocked").limit(1).count() else 0


if __name__ == "__main__":
    sys.exit(main())
