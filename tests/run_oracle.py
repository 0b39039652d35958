"""Compare registered queries with their oracles: python tests/run_oracle.py [sf_dir] [name ...]"""

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import compare  # noqa: E402

from sensorloom.plans import catalog  # noqa: E402
from sensorloom.session import local_session  # noqa: E402

args = sys.argv[1:]
sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
names = [a for a in args if not a.startswith("/")]
spark = local_session(8)
con = compare.connect(sf)
bad = 0
for name, entry in catalog.QUERIES.items():
    if names and not any(n in (name, entry.run.__module__.rsplit(".", 1)[1]) for n in names):
        continue
    t = time.time()
    try:
        rows, problem = compare.check(spark, con, name, entry, sf)
    except Exception as e:  # report and go on
        rows, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
    bad += problem is not None
    print(f"{name:34s} {rows:7d} {time.time() - t:6.1f}s {'sql ' if entry.sql else 'rows'} {'ok' if problem is None else 'FAIL ' + problem}", flush=True)
print("failed:", bad)
