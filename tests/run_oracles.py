"""Compare every registered query with its SQL: python tests/run_oracles.py [folder] [names...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from catalog.oracles import oracles  # noqa: E402
from catalog.queries import queries  # noqa: E402
from feedloom.session import build_session  # noqa: E402
from tests.compare import connect, difference  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    spark = build_session("oracles", "local[8]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql = connect(folder), oracles()
    names = sys.argv[2:] or list(queries())
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = queries()[name](spark, folder)
            if name in sql:
                found = difference(name, df, con, sql[name])
            else:
                print(f"rows only: {name} {df.count()}")
                found = None
        except Exception as error:  # report and go on
            found = f"{name}: {type(error).__name__} {str(error)[:700]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - start:.1f}s {found or ''}", flush=True)
    print(f"{bad} of {len(names)} differ")
