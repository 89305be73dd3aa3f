"""Projections of the sample tables onto the input schemas of the operators (FIXTURES.md, part B)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.operators import sequence as seq

EPOCH_2024 = 1_704_067_200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; zone-less timestamps become UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    for f in df.schema.fields:
        if f.dataType.typeName() == "timestamp_ntz":
            df = df.withColumn(f.name, F.col(f.name).cast("timestamp"))
    return df


def vehicle_class(event_type="event_type"):
    t = F.col(event_type)
    return (
        F.when(t == "view", "T1").when(t == "click", "T3").when(t == "purchase", "T5")
        .when(t == "signup", "T13").otherwise("person")
    )


def ev(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", "ts", (F.col("user_id") % 10).alias("camera_id"),
        F.expr("user_id div 10").alias("track_id"), F.col("value").alias("speed"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        vehicle_class().alias("cls"), "event_type",
    )


def hour_of(ts="ts"):
    return F.floor(F.unix_timestamp(ts) / 3600)


def obs(spark, sf_dir) -> DataFrame:
    """One row per vehicle per frame; frames are runs of eight events of a camera."""
    e = seq.number_rows(ev(spark, sf_dir), ["camera_id"], ["ts", "event_id"], hour_of(), "_n")
    e = e.withColumn("frame_idx", F.expr("(_n - 1) div 8"))
    first = e.groupBy("camera_id", "frame_idx", "track_id").agg(
        F.min_by(F.struct("event_id", "cls", "speed", "k"), "event_id").alias("r")
    )
    i = F.col("r.event_id")
    o = first.select(
        "camera_id", "frame_idx", "track_id", i.alias("event_id"), F.col("r.cls").alias("cls"),
        F.col("r.speed").alias("speed"), F.col("r.k").alias("k"),
        (i * 19 % 1920).cast("double").alias("cx"), (i * 37 % 1080).cast("double").alias("cy"),
        (20 + i % 50).cast("double").alias("w"), (15 + i % 40).cast("double").alias("h"),
    )
    return o.select(
        "*", (F.col("cx") - F.col("w") / 2).alias("x1"), (F.col("cy") - F.col("h") / 2).alias("y1"),
        (F.col("cx") + F.col("w") / 2).alias("x2"), (F.col("cy") + F.col("h") / 2).alias("y2"),
        F.col("frame_idx").cast("double").alias("t"),
    )


SQL_EV = """
ev AS (
  SELECT event_id, ts, user_id % 10 AS camera_id, user_id // 10 AS track_id, value AS speed,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
         CASE event_type WHEN 'view' THEN 'T1' WHEN 'click' THEN 'T3' WHEN 'purchase' THEN 'T5'
              WHEN 'signup' THEN 'T13' ELSE 'person' END AS cls, event_type
  FROM events)"""

SQL_OBS = SQL_EV + """,
ob0 AS (
  SELECT *, (row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id) - 1) // 8 AS frame_idx
  FROM ev),
ob1 AS (
  SELECT *, row_number() OVER (PARTITION BY camera_id, frame_idx, track_id ORDER BY event_id) AS rn
  FROM ob0),
ob2 AS (
  SELECT camera_id, frame_idx, track_id, event_id, cls, speed, k,
         CAST((event_id * 19) % 1920 AS DOUBLE) AS cx, CAST((event_id * 37) % 1080 AS DOUBLE) AS cy,
         CAST(20 + event_id % 50 AS DOUBLE) AS w, CAST(15 + event_id % 40 AS DOUBLE) AS h
  FROM ob1 WHERE rn = 1),
obs AS (
  SELECT *, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2,
         CAST(frame_idx AS DOUBLE) AS t FROM ob2)"""


def triggers(spark, sf_dir) -> DataFrame:
    """One trigger per event, two seconds apart inside a camera."""
    e = seq.number_rows(ev(spark, sf_dir), ["camera_id"], ["ts", "event_id"], hour_of(), "_n")
    return e.select(
        "camera_id", "event_id", F.concat(F.lit("T"), (1 + F.col("event_id") % 7)).alias("type"),
        (F.col("k") / 100.0).alias("severity"), ((F.col("_n") - 1) * 2.0).alias("t"),
        F.col("track_id"), (F.col("_n") - 1).alias("frame_idx"), "ts", "k", "cls",
    )


SQL_TRIG = SQL_EV + """,
trig AS (
  SELECT camera_id, event_id, 'T' || (1 + event_id % 7) AS type, k / 100.0 AS severity,
         (row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id) - 1) * 2.0::DOUBLE AS t,
         track_id, row_number() OVER (PARTITION BY camera_id ORDER BY ts, event_id) - 1 AS frame_idx,
         ts, k, cls
  FROM ev)"""


def _lat(key):
    return 33 + (F.col(key) * 7919 % 6000) / 1000.0


def _lon(key):
    return 124 + (F.col(key) * 104729 % 8000) / 1000.0


def cameras(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select(
        F.col("s_suppkey").alias("cctv_id"), F.col("s_name").alias("name"),
        F.col("n_name").alias("road_name"), _lat("s_suppkey").alias("lat"),
        _lon("s_suppkey").alias("lon"), F.col("s_acctbal").alias("acctbal"),
    )


SQL_CAM = """
cam AS (
  SELECT s_suppkey AS cctv_id, s_name AS name, n_name AS road_name,
         33 + (s_suppkey * 7919 % 6000) / 1000.0 AS lat,
         124 + (s_suppkey * 104729 % 8000) / 1000.0 AS lon, s_acctbal AS acctbal
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""


def incidents(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("link_id"),
        F.col("o_orderdate").alias("occurred_ts"),
        F.date_format("o_orderdate", "yyyyMMddHHmmss").alias("occurred_at"),
        F.col("o_orderstatus").alias("event_type"), F.col("o_orderkey").alias("feed_pos"),
        _lat("o_custkey").alias("lat"), _lon("o_custkey").alias("lon"),
        F.col("o_orderpriority").alias("priority"),
    )


SQL_INC = """
inc AS (
  SELECT o_orderkey AS event_id, o_custkey AS link_id, o_orderdate AS occurred_ts,
         strftime(o_orderdate, '%Y%m%d%H%M%S') AS occurred_at, o_orderstatus AS event_type,
         o_orderkey AS feed_pos, 33 + (o_custkey * 7919 % 6000) / 1000.0 AS lat,
         124 + (o_custkey * 104729 % 8000) / 1000.0 AS lon, o_orderpriority AS priority
  FROM orders)"""


def polls(spark, sf_dir) -> DataFrame:
    """The feed's polls: one for each sign-up, failed where k is divisible by seven."""
    return ev(spark, sf_dir).where("event_type = 'signup'").select(
        F.col("ts").alias("poll_ts"), F.coalesce(F.col("k") % 7 != 0, F.lit(False)).alias("feed_ok"))


SQL_POLLS = """
po AS (SELECT ts AS poll_ts, coalesce(k % 7 <> 0, false) AS feed_ok FROM ev WHERE event_type = 'signup')"""


def listed_incidents(spark, sf_dir) -> DataFrame:
    """Incidents with the hours in which the feed lists them."""
    at = F.lit(EPOCH_2024) + F.col("event_id") * 7919 % 2_592_000
    return incidents(spark, sf_dir).withColumn("listed_from", F.timestamp_seconds(at)).withColumn("listed_until", F.timestamp_seconds(at + 7200))


SQL_LISTED = f"""
li AS (SELECT *, make_timestamp(({EPOCH_2024} + event_id * 7919 % 2592000) * 1000000) AS listed_from,
              make_timestamp(({EPOCH_2024} + event_id * 7919 % 2592000 + 7200) * 1000000) AS listed_until FROM inc)"""


def accidents(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(F.broadcast(n), c.c_nationkey == n.n_nationkey)
        .select(F.col("o_orderkey").alias("event_id"), F.col("n_name").alias("road_name"),
                F.col("o_orderdate").alias("report_time"),
                F.col("o_orderpriority").alias("severity"),
                F.col("o_orderstatus").alias("accident_type"), F.col("c_mktsegment").alias("cause"),
                "c_nationkey", "o_custkey")
    )


SQL_ACC = """
acc AS (
  SELECT o_orderkey AS event_id, n_name AS road_name, o_orderdate AS report_time,
         o_orderpriority AS severity, o_orderstatus AS accident_type, c_mktsegment AS cause,
         c_nationkey, o_custkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


def traj(spark, sf_dir) -> DataFrame:
    """Clip trajectories: one clip per supplier, twelve tracks each."""
    li = table(spark, sf_dir, "lineitem").withColumn("track_id", F.col("l_partkey") % 12)
    every = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity",
             "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    li = seq.number_rows(li, ["l_suppkey", "track_id"], every, month, "frame")
    return li.select(
        F.col("l_suppkey").alias("clip_id"), "track_id", "frame",
        (F.col("l_quantity") / 50).alias("x"), (F.col("l_discount") * 10).alias("y"),
        F.col("l_extendedprice").alias("price"), F.col("l_tax").alias("tax"),
        F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("lane"),
    )


SQL_TRAJ = """
traj AS (
  SELECT l_suppkey AS clip_id, l_partkey % 12 AS track_id,
         row_number() OVER (PARTITION BY l_suppkey, l_partkey % 12 ORDER BY l_shipdate, l_orderkey,
           l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
           l_linestatus) AS frame,
         l_quantity / 50 AS x, l_discount * 10 AS y, l_extendedprice AS price, l_tax AS tax,
         l_returnflag AS flag, l_linenumber AS lane
  FROM lineitem)"""


def chunks(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"),
        F.col("lang").alias("domain"), F.col("source").alias("document_type"),
        F.when(F.col("n_chars") % 7 != 0, F.col("n_chars") % 240).alias("closure_min"),
        (F.col("n_chars") % 5).alias("casualties"), "n_chars",
    )


SQL_CHUNKS = """
chunks AS (
  SELECT doc_id AS chunk_id, text AS chunk_text, lang AS domain, source AS document_type,
         CASE WHEN n_chars % 7 <> 0 THEN n_chars % 240 END AS closure_min,
         n_chars % 5 AS casualties, n_chars
  FROM documents)"""
