"""Runs two small workloads with event logging on: write_real_logs.py LOG_DIR SF_DIR OUT_DIR MODE"""

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

log_dir, sf_dir, out_dir, mode = sys.argv[1:]
builder = (
    SparkSession.builder.master("local[2]")
    .config("spark.ui.enabled", "false")
    .config("spark.sql.shuffle.partitions", "4")
    .config("spark.eventLog.enabled", "true")
    .config("spark.eventLog.dir", log_dir)
    .config("spark.eventLog.rolling.enabled", str(mode == "rolled").lower())
    .config("spark.eventLog.compress", str(mode == "rolled").lower())
)
spark = builder.getOrCreate()
lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
(
    lineitem.filter("l_quantity > 10")
    .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    .groupBy("o_orderpriority")
    .agg(F.sum("l_extendedprice"))
    .collect()
)
lineitem.filter("l_quantity > 10").write.parquet(f"{out_dir}/copy")
spark.stop()
