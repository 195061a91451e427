"""Command line check: python tests/run_oracles.py SF [name ...]"""

import sys
import time

sys.path.insert(0, "/root/repo")
import __spark_entry__ as entry  # noqa: E402
from tests.compare import connect, differences  # noqa: E402

from loomline.functions.session import local_session  # noqa: E402

sf, names = sys.argv[1], sys.argv[2:]
spark = local_session(8)
con = connect(f"/root/testdata/{sf}")
queries, oracles = entry.queries(), entry.oracle_sql()
for name in names or list(queries):
    start = time.time()
    try:
        got = queries[name](spark, f"/root/testdata/{sf}").toPandas()
        spent = time.time() - start
        if name in oracles:
            mid = time.time()
            problem = differences(got, con.execute(oracles[name]).df())
            print(f"{name:34s} {'ok ' if problem is None else 'BAD'} rows={len(got)} {spent:.2f}s oracle {time.time() - mid:.2f}s {problem or ''}", flush=True)
        else:
            print(f"{name:34s} rows={len(got)} {spent:.2f}s\n{got.head(3)}", flush=True)
    except Exception as exc:
        print(f"{name:34s} FAIL {type(exc).__name__}: {str(exc)[:300]}", flush=True)
