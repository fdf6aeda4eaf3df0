"""python tests/run_checks.py [name-prefix ...]: run registered queries against DuckDB and time them."""

import os
import sys
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import __spark_entry__ as entry  # noqa: E402
import oracle  # noqa: E402
from tallyframe.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session(8), oracle.connect(sf)
    queries, sqls, bad = entry.queries(), entry.oracle_sql(), 0
    for name, q in queries.items():
        if sys.argv[1:] and not any(name.startswith(p) for p in sys.argv[1:]):
            continue
        t = time.time()
        try:
            if name in sqls:
                n, err = oracle.compare(spark, con, q, sqls[name], sf)
            else:
                n, err = q(spark, sf).count(), None
        except Exception as e:  # report and go on
            n, err = -1, "".join(traceback.format_exception_only(e))[:1500]
            if os.environ.get("TB"):
                traceback.print_exc()
        bad += err is not None
        print(f"{'ok ' if err is None else 'BAD'} {name:34s} rows={n:6d} {time.time() - t:6.2f}s {'' if name in sqls else '(rows only)'} {err or ''}", flush=True)
    print("bad:", bad)
