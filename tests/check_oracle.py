"""Command line check: python tests/check_oracle.py [sf] [name-part ...]."""

import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from tests.comparison import connect, difference  # noqa: E402
from tillspark.plans import registry  # noqa: E402
from tillspark.session import build_session, clear_work  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
wanted = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
if os.environ.get("CHECK_PLAIN"):  # a session without any of our settings
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false") \
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
else:
    spark = build_session(
        "check", "local[8]", **{"spark.checkpoint.dir": "/tmp/tillspark-check"})
con = connect(sf_dir)
oracle = registry.oracle_sql()
failed = 0
for name, run in registry.queries().items():
    if wanted and not any(w in name for w in wanted):
        continue
    begin = time.time()
    try:
        df = run(spark, sf_dir)
        if name in oracle:
            text = difference(df, con, oracle[name]) or "ok"
            text += f" rows={df.count()}" if text == "ok" and len(wanted) else ""
        else:
            text = f"no sql, rows {df.count()}"
    except Exception as error:  # reported for each query
        text = f"ERROR {str(error)[:700]}"
    failed += not text.startswith(("ok", "no sql"))
    print(f"{name:32s} {time.time() - begin:6.2f}s  {text}", flush=True)
clear_work(spark)
print("failed", failed)
