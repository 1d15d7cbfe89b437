"""Run registered queries against their SQL twins: python tests/check.py [sf_dir] [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from compare import connect, differences  # noqa: E402

from vistrata.catalog import QUERIES, SQL  # noqa: E402
from vistrata.session import local_session  # noqa: E402

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, failed = local_session("8"), connect(sf_dir), []
    for name in names:
        started = time.time()
        try:
            if name in SQL:
                found = differences(spark, con, QUERIES[name], SQL[name], sf_dir)
            else:
                found = [] if QUERIES[name](spark, sf_dir).count() > 0 else ["no rows"]
        except Exception as error:  # noqa: BLE001
            found = [f"{type(error).__name__}: {str(error)[:700]}"]
        print(f"{'FAIL' if found else 'ok  '} {time.time() - started:6.2f}s {name} {'' if name in SQL else '(rows only) '}"
              f"{' | '.join(found)[:1200]}", flush=True)
        failed += [name] if found else []
    print(f"{len(names)} queries, failed: {failed}")
