"""python -m stemma {process,build,queries}"""

from __future__ import annotations

import argparse

from stemma import config as C
from stemma import jobs
from stemma.session import build_session


def main(argv: list[str] | None = None) -> None:
    ap = argparse.ArgumentParser(prog="stemma")
    ap.add_argument("--config")
    sub = ap.add_subparsers(dest="command", required=True)
    for name in ("process", "build"):
        p = sub.add_parser(name)
        p.add_argument("root")
        p.add_argument("out")
    q = sub.add_parser("query")
    q.add_argument("name")
    q.add_argument("tables")
    sub.add_parser("list")
    a = ap.parse_args(argv)
    conf = C.load(a.config)
    from stemma.plans import all_queries

    if a.command == "list":
        print("\n".join(all_queries()))
        return
    spark = build_session()
    if a.command == "process":
        print(jobs.process(spark, a.root, a.out, conf).read().count(), "documents")
    elif a.command == "build":
        for name, df in jobs.build(spark, a.root, a.out, conf).items():
            print(name, df.count())
    else:
        all_queries()[a.name](spark, a.tables).show(20, False)


if __name__ == "__main__":
    main()
