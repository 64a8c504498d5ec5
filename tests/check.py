"""Run registered queries against their oracles: python tests/check.py [-d DIR] [name ...]."""

from __future__ import annotations

import argparse
import os
import sys
import time
import traceback

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from tests.oracle import compare, connect  # noqa: E402
from touchmark.plans import all_oracles, all_queries  # noqa: E402
from touchmark.session import build_session  # noqa: E402


def main() -> None:
    parser = argparse.ArgumentParser()
    parser.add_argument("-d", "--directory", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark, con = build_session(), connect(args.directory)
    oracles, failed = all_oracles(), []
    for name, query in all_queries().items():
        if args.names and name not in args.names:
            continue
        start = time.time()
        try:
            df = query(spark, args.directory)
            rows = compare(df, con, oracles[name]) if name in oracles else len(df.collect())
            kind = "ok " if name in oracles else "run"
            print(f"{kind} {name:32} {rows:8} rows {time.time() - start:6.2f}s", flush=True)
        except Exception as error:  # noqa: BLE001
            failed.append(name)
            print(f"BAD {name}: {type(error).__name__} {str(error)[:600]}", flush=True)
            if len(args.names) == 1:
                traceback.print_exc()
    print("failed:", failed)


if __name__ == "__main__":
    main()
