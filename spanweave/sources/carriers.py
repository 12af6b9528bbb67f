"""The engine's inputs, read from Parquet tables with fixed projections (only the columns used are scanned).

* pulses: ``stream_id, court_id, ts, height, event_id``
* energy: ``court_id, ts, energy, e5`` (e5: energy in hundred-thousandths, for sums that do not depend on their order)
* spans: ``stream_id, span_id, start, end, confidence`` (in days)
* track: ``stream_id, ts, x, y``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.units import days, micros

COURTS = 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pulses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type <> 'error'")
    return e.select(F.col("user_id").alias("stream_id"), (F.col("user_id") % COURTS).alias("court_id"), micros("ts").alias("ts"), F.col("value").alias("height"), "event_id")


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % COURTS).alias("court_id"), micros("ts").alias("ts"), (F.col("value") / 1000.0).alias("energy"), F.round(F.col("value") * 100).cast("long").alias("e5"))


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").alias("stream_id"), micros("ts").alias("ts"), (F.col("value") / 500.0).alias("x"), (k / 100.0).alias("y"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("shipped"))
    o = table(spark, sf_dir, "orders").join(last, F.col("o_orderkey") == F.col("l_orderkey"))
    return o.select(F.col("o_custkey").alias("stream_id"), F.col("o_orderkey").alias("span_id"), days("o_orderdate").alias("start"), days("shipped").alias("end"), ((F.col("o_orderkey") % 100) / 100.0).alias("confidence"))


#: The same inputs as SQL common table expressions.
SQL = {
    "pulses": "pulses AS (SELECT user_id AS stream_id, user_id % 10 AS court_id, epoch_us(ts) AS ts, value AS height, event_id FROM events WHERE event_type <> 'error')",
    "energy": "energy AS (SELECT user_id % 10 AS court_id, epoch_us(ts) AS ts, value / 1000.0 AS energy, CAST(round(value * 100) AS BIGINT) AS e5 FROM events)",
    "track": "track AS (SELECT user_id AS stream_id, epoch_us(ts) AS ts, value / 500.0 AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100.0 AS y FROM events)",
    "spans": "spans AS (SELECT o_custkey AS stream_id, o_orderkey AS span_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS start_at, date_diff('day', DATE '1970-01-01', CAST(shipped AS DATE)) AS end_at, (o_orderkey % 100) / 100.0 AS confidence FROM orders JOIN (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)",
}


def ctes(*names: str) -> str:
    return "WITH " + ", ".join(SQL[n] for n in names)
