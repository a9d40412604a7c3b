"""Command line: show a query's rows, or answer a question over a data folder.

    python -m pitchlake.cli show teammate_edges /path/to/tables
    python -m pitchlake.cli ask "A B có từng chơi cho CLB C không?" /path/to/tables
"""

from __future__ import annotations

import argparse


def main(arguments: list[str] | None = None) -> str:
    """Run a command and return what it prints."""
    parser = argparse.ArgumentParser(prog="pitchlake")
    parser.add_argument("command", choices=("show", "ask", "list"))
    parser.add_argument("what", nargs="?", default="")
    parser.add_argument("folder", nargs="?", default=".")
    parser.add_argument("--rows", type=int, default=20, help="rows to show")
    given = parser.parse_args(arguments)
    from pyspark.sql import SparkSession

    from pitchlake.plans import load
    from pitchlake.plans.registry import QUERIES

    load()
    if given.command == "list":
        out = "\n".join(f"{n}: {(f.__doc__ or '').splitlines()[0]}" for n, f in sorted(QUERIES.items()))
    else:
        spark = SparkSession.builder.appName("pitchlake").getOrCreate()
        if given.command == "show":
            df = QUERIES[given.what](spark, given.folder).limit(given.rows)
            out = "\n".join(["\t".join(df.columns), *["\t".join(str(v) for v in r) for r in df.collect()]])
        else:
            from pitchlake.plans.answers import answer
            from pitchlake.plans.questions import question_facts

            q = spark.createDataFrame([(1, given.what, None, "")], "no int, question string, choices array<string>, expected string")
            found = answer(q, question_facts(spark, given.folder)).first()
            words = {"true": "Đúng", "false": "Sai", "yes": "Có", "no": "Không"}
            out = "Câu hỏi chưa hiểu được." if found is None else f"{words.get(found.given, found.given)} ({found.confidence})"
    print(out)
    return out


if __name__ == "__main__":
    main()
