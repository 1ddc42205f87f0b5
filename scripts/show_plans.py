"""Print the executed (final AQE) physical plan of selected registered queries.

Usage: python scripts/show_plans.py [sf_dir] [name ...]
Collects each query first so that the plan shown is the one AQE settled on
(final stages, codegen ids, broadcast decisions); prints the operator tree
only. Use a small scale: results are collected.
"""

from __future__ import annotations

import sys

sys.path.insert(0, ".")
from relayspark.plans.catalog import QUERIES  # noqa: E402
from relayspark.session import build_session, plan_text  # noqa: E402


def tree(text: str) -> str:
    lines = text.splitlines()
    out = []
    for line in lines[1:]:
        if not line.strip():
            break
        out.append(line)
    return "\n".join(out)


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = build_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    for name in names:
        df = QUERIES[name](spark, sf_dir)
        df.collect()
        print(f"### {name}\n\n```\n{tree(plan_text(df))}\n```\n")


if __name__ == "__main__":
    main()
