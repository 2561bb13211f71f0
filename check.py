"""Compare registered queries with their oracles: python check.py [sf_dir] [name or module prefix ...]"""

import sys
import time

from ranklab.catalog import ORACLES, QUERIES, load_all
from ranklab.session import build_session
from tests.oracle import compare, connect


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    load_all()
    wanted = sys.argv[2:]
    names = [n for n in QUERIES if not wanted or n in wanted or QUERIES[n].__module__.split(".")[-1] in wanted]
    spark = build_session("check", "local[8]", 8, **{"spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for name in names:
        start = time.time()
        try:
            frame = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                problem = compare(frame, connect(sf_dir), ORACLES[name])
            else:
                problem = None if frame.count() else "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - start
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {took:6.1f}s {name}{'' if problem is None else ' :: ' + problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
