"""Camera geometry, reference dimensions and knowledge-base layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONFIG_SCHEMA = (
    "camera_id string, frame_w int, frame_h int, expected_heading double, "
    "roi array<struct<name:string,type:string,polygon:array<struct<x:double,y:double>>>>, "
    "lanes array<struct<id:string,direction:string,line:array<struct<x:double,y:double>>>>, "
    "scale double, h array<double>, count_line_y double, validity_band array<double>")

# fixed values: thirteen vehicle classes
VEHICLE_CLASSES = {
    "T1": "승용차", "T2": "버스", "T3": "소형화물", "T4": "중형화물", "T5": "대형화물",
    "T6": "대형특수4축", "T7": "대형특수5축", "T8": "세미트레일러4축", "T9": "풀트레일러4축",
    "T10": "세미트레일러5축", "T11": "풀트레일러5축", "T12": "세미트레일러6축", "T13": "이륜차"}
# fixed values: source categories -> 13-type and 5-class groups
CATEGORY_13 = {"승용차": "승용", "SUV": "승용", "트럭 1t": "화물(소)", "트럭 5t": "화물(대)", "덤프트럭": "화물(대)",
               "탱크로리": "특수", "소형버스": "승합(소)", "대형버스": "승합(대)", "특수차량": "특수"}
CATEGORY_5 = {"승용차": "승용", "SUV": "승용", "트럭 1t": "화물", "트럭 5t": "화물", "덤프트럭": "화물",
              "탱크로리": "특수", "소형버스": "버스", "대형버스": "버스", "특수차량": "특수"}
# fixed values: candidate hotspots (name, lat, lon, road)
HOTSPOTS = [
    ("서해안선 발안IC-비봉IC", 37.11, 126.89, "서해안선"), ("경부선 수원-오산", 37.15, 127.05, "경부선"),
    ("영동선 여주JC", 37.29, 127.64, "영동선"), ("경부선 안성JC", 37.00, 127.10, "경부선"),
    ("서해안선 서평택IC", 36.95, 126.90, "서해안선"), ("중부내륙선 여주JC", 37.28, 127.60, "중부내륙선"),
    ("통영대전선 함양JC", 35.50, 127.80, "통영대전선")]


def vehicle_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(VEHICLE_CLASSES.items()), "cls string, name string")


def hotspots(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HOTSPOTS, "name string, site_lat double, site_lon double, road string")


def map_category(df: DataFrame, col: str, out: str, five: bool = False) -> tuple[DataFrame, DataFrame]:
    """Mapped rows, and rows whose category is unknown."""
    table = CATEGORY_5 if five else CATEGORY_13
    m = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    d = df.withColumn(out, F.try_element_at(m, F.col(col)))
    return d.where(F.col(out).isNotNull()), d.where(F.col(out).isNull()).drop(out)


def default_config(camera_id: str, w: int = 1920, h: int = 1080) -> dict:
    """Without a drawing the whole frame is road."""
    box = [(0.0, 0.0), (float(w), 0.0), (float(w), float(h)), (0.0, float(h))]
    return {"camera_id": camera_id, "frame_w": w, "frame_h": h, "roi": [
        {"name": "road", "type": "road", "polygon": [{"x": x, "y": y} for x, y in box]}], "lanes": []}


def load_configs(path: str) -> list[dict]:
    """Camera drawings from a YAML document: one mapping or a list under `cameras`."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    out = []
    for c in doc.get("cameras", [doc]):
        d = default_config(str(c.get("camera_id", "default")), int(c.get("frame_w", 1920)),
                           int(c.get("frame_h", 1080)))
        pts = lambda ps: [{"x": float(x), "y": float(y)} for x, y in ps]
        if c.get("roi"):
            d["roi"] = [{"name": r.get("name", ""), "type": r.get("type", "road"),
                         "polygon": pts(r["polygon"])} for r in c["roi"]]
        d["lanes"] = [{"id": str(n["id"]), "direction": n.get("direction", ""),
                       "line": pts(n["polyline"])} for n in c.get("lanes") or []]
        for k in ("expected_heading", "scale", "count_line_y"):
            d[k] = None if c.get(k) is None else float(c[k])
        d["h"] = [float(v) for row in c["homography"] for v in row] if c.get("homography") else None
        d["validity_band"] = c.get("validity_band")
        out.append(d)
    return out


def config_frame(spark: SparkSession, configs: list[dict]) -> DataFrame:
    return spark.createDataFrame(configs, CONFIG_SCHEMA)


# fixed values: the parts columns play in a knowledge base: tables that may hold them, names they go by
ROLES = {
    "chunk_text": (("chunk",), ("chunk_text", "text", "content")),
    "chunk_id": (("chunk",), ("chunk_id", "id")),
    "keywords": (("chunk",), ("keywords_json", "keywords")),
    "document_id": (("chunk",), ("document_id", "doc_id")),
    "domain": (("chunk", "document"), ("domain",)),
    "document_type": (("chunk", "document"), ("document_type",)),
    "vector": (("table", "chunk"), ("embedding_json", "embedding", "vector_json", "vector", "embedding_vector")),
    "model": (("table", "chunk"), ("embedding_model", "model", "model_name")),
    "current": (("table",), ("is_current", "current", "active")),
}


def resolve(role: str, tables: dict[str, DataFrame]) -> tuple[str | None, str | None]:
    """(table, column) of a role: the first table that has it, under the first of its names."""
    places, names = ROLES[role]
    found = ((t, n) for t in places if t in tables for n in names if n in tables[t].columns)
    return next(found, (None, None))


def probe(chunks: DataFrame, documents: DataFrame | None = None,
          embeddings: DataFrame | None = None) -> dict:
    """Which column plays which part, and where the embeddings are.

    Documents count only if chunks name theirs. Vectors of a table of their own are joined by chunk id,
    so they are off (`vectors_in` None) where chunks have no id or share one.
    """
    given = {"chunk": chunks, "document": documents, "table": embeddings}
    tables = {k: v for k, v in given.items() if v is not None}
    s = {role: resolve(role, tables)[1] for role in ("chunk_text", "chunk_id", "keywords", "document_id")}
    if not s["document_id"]:
        tables.pop("document", None)
    s |= {role: resolve(role, tables)[0] for role in ("domain", "document_type")}
    s["usable"] = s["chunk_text"] is not None
    s["vectors_in"], s["vector"] = resolve("vector", tables)
    beside = {s["vectors_in"]: tables[s["vectors_in"]]} if s["vectors_in"] else {"chunk": chunks}
    s["model"], s["current"] = resolve("model", beside)[1], resolve("current", beside)[1]
    if s["vectors_in"] == "table" and not unique(chunks, s["chunk_id"]):
        s["vectors_in"] = None
    return s


def unique(rows: DataFrame, column: str | None) -> bool:
    """Whether a column is there and no value of it repeats."""
    return column is not None and rows.groupBy(column).count().where("count > 1").isEmpty()


def knowledge_rows(chunks: DataFrame, s: dict) -> DataFrame:
    """Chunks under their standard names."""
    from tarmac.functions.text import keywords

    kw = F.array().cast("array<string>")
    if s["keywords"]:
        c = F.col(s["keywords"])
        kw = keywords(c) if dict(chunks.dtypes)[s["keywords"]] == "string" else c
    idc = F.col(s["chunk_id"]) if s["chunk_id"] else F.lit(None).cast("string")
    return chunks.select(idc.alias("chunk_id"), F.col(s["chunk_text"]).alias("chunk_text"), kw.alias("keywords"),
                         *[c for c in ("domain", "document_type") if c in chunks.columns])


def calibration_audit(points: DataFrame) -> DataFrame:
    """Scale and reprojection error per camera from point pairs and a given matrix.

    Input: camera_id, px, py, wx, wy, h array<double>[9], scale.
    """
    from tarmac.functions.geo import project

    p = points.withColumn("_w", project(F.col("px"), F.col("py"), F.col("h"), F.col("scale")))
    e2 = F.pow(F.col("_w.x") - F.col("wx"), F.lit(2)) + F.pow(F.col("_w.y") - F.col("wy"), F.lit(2))
    spread = lambda c: F.max(c) - F.min(c)
    return p.groupBy("camera_id").agg(
        F.count("*").alias("points"), F.sqrt(F.avg(e2)).alias("rmse_m"),
        F.try_divide(F.hypot(spread("wx"), spread("wy")), F.hypot(spread("px"), spread("py")))
        .alias("scale_m_per_px"))
