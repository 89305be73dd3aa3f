"""File readers: label clips, trajectories, logs, recordings, report sheets, observation streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELS = {"정상": "normal", "비정상": "abnormal"}  # fixed values: label folders

CLIP_SCHEMA = (
    "annotation array<struct<id:bigint,bbox:array<double>,category:string,DrivingType:string,"
    "leftLine:string,safetydistance:int>>, imageInfo struct<width:int,height:int>")
OBS_SCHEMA = (
    "camera_id string, frame_idx long, ts timestamp, track_id long, x1 double, y1 double, x2 double, "
    "y2 double, conf double, cls string, coco_cls int")


def label_clips(spark: SparkSession, root: str, max_clips: int | None = None) -> DataFrame:
    """Frames of `{label}/{subtype}/{clip}/*.json`; the frame number ends the file name.

    `max_clips` keeps half of it per label, in subtype and clip order, as the reader's own option.
    """
    raw = spark.read.schema(CLIP_SCHEMA).option("multiLine", True).option(
        "recursiveFileLookup", True).json(root)
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    f = raw.select("annotation", "imageInfo", path.alias("_p")).select(
        F.element_at(F.split("_p", "/"), -4).alias("label"),
        F.element_at(F.split("_p", "/"), -3).alias("subtype"),
        F.element_at(F.split("_p", "/"), -2).alias("clip_id"),
        F.regexp_extract("_p", r"(\d+)\.json$", 1).try_cast("int").alias("frame_idx"),
        "annotation", "imageInfo")
    f = f.where(F.col("label").isin(*LABELS))
    if max_clips:
        # the clip list, not the frames, is ranked
        clips = f.select("label", "subtype", "clip_id").distinct()
        w = Window.partitionBy("label").orderBy("subtype", "clip_id")
        keep = clips.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_clips // 2).drop("_r")
        f = f.join(keep, ["label", "subtype", "clip_id"], "left_semi")
    return f


def clip_boxes(frames: DataFrame) -> DataFrame:
    """One row per labelled vehicle per frame."""
    v = frames.select("label", "subtype", "clip_id", F.col("frame_idx").alias("frame"),
                      F.explode("annotation").alias("v"))
    b = F.col("v.bbox")
    return v.select(
        "label", "subtype", "clip_id", "frame", F.coalesce("v.id", F.lit(0)).alias("track_id"),
        (b[0] + b[2] / 2).alias("cx"), (b[1] + b[3] / 2).alias("cy"), b[2].alias("w"), b[3].alias("h"),
        F.coalesce("v.leftLine", F.lit("")).alias("lane"),
        F.coalesce("v.safetydistance", F.lit(0)).alias("unsafe"), F.col("v.DrivingType").alias("driving"))


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Whitespace-separated `frame track agent x y ...` lines; short or unreadable lines are skipped."""
    p = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(
        F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1).alias("clip_id"), p.alias("p"))
    t = t.where(F.size("p") >= 5).select(
        "clip_id", F.get("p", F.lit(0)).try_cast("long").alias("frame"),
        F.get("p", F.lit(1)).try_cast("long").alias("track_id"),
        F.get("p", F.lit(3)).try_cast("double").alias("x"), F.get("p", F.lit(4)).try_cast("double").alias("y"))
    return t.dropna()


def labelled_split(spark: SparkSession, path: str) -> DataFrame:
    """Trajectories with the class from the file name: `_an1`..`_an9` abnormal, others normal."""
    t = trajectories(spark, path)
    kind = F.regexp_extract("clip_id", r"_(an[0-9])", 1)
    return t.withColumn("type", F.when(kind == "", "normal").otherwise(kind)).withColumn(
        "y", (kind != "").cast("int"))


def json_log(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON-lines log: readable rows, and the raw lines that are not JSON of this shape."""
    full = T._parse_datatype_string(schema).add("_corrupt_record", T.StringType())
    raw = spark.read.schema(full).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    good = raw.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    lines = spark.read.text(path).where((F.trim("value") != "") & F.try_parse_json("value").isNull())
    return good, lines.withColumnRenamed("value", "line")


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """Inventory of `{day}/{camera}_hls/*.mp4|*.ts` without reading contents."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
         .option("pathGlobFilter", "*.{mp4,ts,MP4,TS}").load(root).drop("content"))
    return f.select(
        "path", F.regexp_extract("path", r"/([^/]+)_hls/[^/]+$", 1).alias("camera"),
        F.regexp_extract("path", r"/(\d{8})/[^/]+/[^/]+$", 1).alias("day"), "length",
        F.unix_seconds("modificationTime").alias("mtime"))


def report_sheet(spark: SparkSession, path: str) -> DataFrame:
    """A report sheet saved as CSV, header row kept as column names, empty rows dropped."""
    s = spark.read.option("header", True).option("multiLine", True).csv(path)
    filled = F.array_compact(F.array(*[F.nullif(F.trim(F.col(f"`{c}`")), F.lit("")) for c in s.columns]))
    return s.where(F.size(filled) > 0)


def observation_stream(spark: SparkSession, path: str, per_trigger: int = 100) -> DataFrame:
    """Vehicle observations landing as parquet files."""
    return spark.readStream.schema(OBS_SCHEMA).option("maxFilesPerTrigger", per_trigger).parquet(path)


def observation_topic(spark: SparkSession, servers: str, topic: str, rate: int = 100_000) -> DataFrame:
    """Vehicle observations from a Kafka topic of JSON rows (needs the Kafka connector)."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("maxOffsetsPerTrigger", rate).load())
    return raw.select(F.from_json(F.col("value").cast("string"), OBS_SCHEMA).alias("o")).select("o.*")
