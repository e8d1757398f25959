"""``python tests/check_oracles.py [sf_dir] [name part ...]``: compare queries with their SQL."""

import os
import sys
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import compare, connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from fleetlag.session import build_session  # noqa: E402


def main(argv):
    sf = argv[0] if argv and argv[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in argv if not a.startswith("/")]
    spark = build_session(f"local[{os.environ.get("CPUS", 8)}]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        try:
            if name in oracles:
                n, took, problems = compare(spark, con, fn, oracles[name], sf)
            else:
                import time
                t0 = time.time()
                n, problems = len(fn(spark, sf).collect()), []
                took = time.time() - t0
        except Exception as exc:
            n, took, problems = -1, 0, [str(exc)[:700]]
            if len(parts) == 1:
                traceback.print_exc()
        print(f"{'ok ' if not problems else 'BAD'} {name:34s} {n:7d} rows {took:6.2f}s {'' if name in oracles else '(no sql)'}", flush=True)
        for p in problems:
            print("     ", p[:900], flush=True)
        bad += [name] if problems else []
    print("failed:", bad)


main(sys.argv[1:])
