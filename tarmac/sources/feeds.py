"""Camera catalogue, incident feed and camera feed readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions import text as X

# fixed values: incident kinds by keyword
KINDS = ("사고", "고장", "공사", "기상", "재난")

_STR = T.StringType()
CAMERA_FIELDS = ["name", "cctv_name", "slug", "x", "coordx", "lon", "lng", "y", "coordy", "lat", "route",
                 "cctv_road", "hotspot_road", "url", "cctvurl", "hls_url"]
CAMERA_SCHEMA = T.StructType([T.StructField(c, _STR) for c in CAMERA_FIELDS])

_ITEM = T.StructType([T.StructField(c, _STR) for c in (
    "linkId", "eventType", "eventDetailType", "type", "roadName", "roadNo", "roadDrcType", "coordX",
    "coordY", "startDate", "message", "lanesBlocked")])
INCIDENT_SCHEMA = T.StructType([
    T.StructField("resultCode", _STR),
    T.StructField("header", T.StructType([T.StructField("resultCode", _STR)])),
    T.StructField("body", T.StructType([T.StructField("items", T.ArrayType(_ITEM))])),
    T.StructField("_corrupt_record", _STR)])

_CCTV = T.StructType([T.StructField(c, _STR) for c in (
    "roadsectionid", "cctvname", "coordx", "coordy", "cctvurl", "cctvresolution")])
CCTV_SCHEMA = T.StructType([T.StructField("response", T.StructType([
    T.StructField("data", T.ArrayType(_CCTV))]))])


def _filled(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(n), F.lit("")) for n in names])


def camera_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Camera list in either of its two JSON layouts. A camera without coordinates is an error."""
    raw = spark.read.schema(CAMERA_SCHEMA).option("multiLine", True).json(path)
    c = raw.select(
        _filled("name", "cctv_name", "slug").alias("name"),
        _filled("x", "coordx", "lon", "lng").try_cast("double").alias("lon"),
        _filled("y", "coordy", "lat").try_cast("double").alias("lat"),
        F.coalesce(_filled("route", "cctv_road", "hotspot_road"), F.lit("")).alias("route"),
        F.coalesce(_filled("url", "cctvurl", "hls_url"), F.lit("")).alias("stream_url"))
    bad = F.col("lon").isNull() | F.col("lat").isNull()
    return c.withColumn("lon", F.when(bad, F.raise_error(F.concat(
        F.lit("camera without coordinates: "), F.coalesce("name", F.lit("?"))))).otherwise(F.col("lon")))


def _flatten_incidents(raw: DataFrame) -> DataFrame:
    code = F.coalesce("header.resultCode", "resultCode", F.lit("0"))
    ok = F.col("_corrupt_record").isNull() & code.isin("0", "00")
    base = raw.select(
        F.col("_metadata.file_path").alias("poll"),
        F.col("_metadata.file_modification_time").alias("polled_at"), ok.alias("feed_ok"),
        F.when(ok, F.col("body.items")).alias("items"))
    return base


def _incident_columns(item: str = "item") -> list[Column]:
    i = F.col(item)
    return [
        i["linkId"].alias("event_id"), i["eventType"].alias("event_type"),
        i["eventDetailType"].alias("event_detail"), i["type"].alias("road_type"),
        i["roadName"].alias("road_name"), i["roadNo"].alias("road_no"),
        i["roadDrcType"].alias("direction"), i["coordY"].try_cast("double").alias("lat"),
        i["coordX"].try_cast("double").alias("lon"), i["startDate"].alias("occurred_at"),
        F.try_to_timestamp(i["startDate"], F.lit("yyyyMMddHHmmss")).alias("occurred_ts"),
        i["message"].alias("message"), i["lanesBlocked"].alias("lanes_blocked"),
        i["linkId"].alias("link_id")]


def incident_feed(spark: SparkSession, path: str) -> DataFrame:
    """Incidents of every landed poll; numbers that do not parse are null, failed polls have none."""
    raw = spark.read.schema(INCIDENT_SCHEMA).option("multiLine", True).json(path)
    return _flatten_incidents(raw).select(
        "poll", "polled_at", F.posexplode("items").alias("feed_pos", "item")).select(
        "poll", "polled_at", F.col("feed_pos").cast("long").alias("feed_pos"), *_incident_columns())


def feed_status(spark: SparkSession, path: str) -> DataFrame:
    """One row per poll: whether the feed answered, and with how many incidents.

    Zero incidents from a healthy feed and an unanswered poll are different things.
    """
    raw = spark.read.schema(INCIDENT_SCHEMA).option("multiLine", True).json(path)
    return _flatten_incidents(raw).select(
        "poll", "polled_at", "feed_ok", F.when(F.col("feed_ok"), F.coalesce(F.size("items"), F.lit(0)))
        .alias("n_items"))


def incident_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    raw = (spark.readStream.schema(INCIDENT_SCHEMA).option("multiLine", True)
           .option("maxFilesPerTrigger", per_trigger).json(path))
    return _flatten_incidents(raw).select("poll", F.explode("items").alias("item")).select(
        "poll", *_incident_columns())


def camera_feed(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None):
    """Cameras of a feed payload; the id is the section id, else a slug of the name.

    `box` keeps (min_lon, max_lon, min_lat, max_lat).
    """
    raw = spark.read.schema(CCTV_SCHEMA).option("multiLine", True).json(path)
    c = raw.select(F.explode("response.data").alias("c")).select(
        F.coalesce(F.nullif("c.roadsectionid", F.lit("")), X.slug("c.cctvname")).alias("cctv_id"),
        F.col("c.cctvname").alias("name"),
        F.coalesce(F.col("c.coordy").try_cast("double"), F.lit(0.0)).alias("lat"),
        F.coalesce(F.col("c.coordx").try_cast("double"), F.lit(0.0)).alias("lon"),
        F.col("c.cctvurl").alias("stream_url"), F.col("c.cctvresolution").alias("resolution"))
    if box:
        c = c.where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]))
    return c


def classify(text: str, kinds: dict[str, str] | None = None, other: str = "기타") -> Column:
    """Kind of the first keyword contained in the text."""
    table = kinds or {k: k for k in KINDS}
    out = None
    for word, kind in table.items():
        hit = F.col(text).contains(word)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise(other)


def wanted(incidents: DataFrame, targets: list[str], col: str = "event_type") -> DataFrame:
    """Incidents whose type contains any target word."""
    ok = F.lit(False)
    for t in targets:
        ok = ok | F.col(col).contains(t)
    return incidents.where(ok)
