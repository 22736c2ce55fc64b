"""python -m tests.compare [names...]: every query against its SQL, with times."""

import os
import sys
import time

from tablehaul.session import build_session
from tests.oracle import connect, differences

import __spark_entry__ as entry

if __name__ == "__main__":
    sf = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("compare", os.environ.get("CORES", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[1:] or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf)
            problems = differences(df, con, oracles[name]) if name in oracles else [f"no SQL; {df.count()} rows"]
        except Exception as error:
            problems = ["FAILED " + str(error)[:1500]]
        bad += bool(problems)
        print(f"{'ok ' if not problems else 'BAD'} {name} {time.time() - start:.1f}s", *problems, sep="\n      " if problems else " ", flush=True)
    print("bad:", bad)
