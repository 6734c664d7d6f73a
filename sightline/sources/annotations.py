"""Readers of annotation files and result files: everything as DataFrames with declared schemas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sightline.operators.prune import dense_ids, require_subset
from sightline.runtime import materialize

IMAGE_SET = (
    "struct<images:array<struct<id:long,file_name:string,width:int,height:int,text_input:string>>,"
    "annotations:array<struct<id:long,image_id:long,category_id:long,bbox:array<double>,area:double,iscrowd:int>>,categories:array<struct<id:long,name:string>>>"
)
VIDEO_SET = (
    "struct<videos:array<struct<id:string,video_name:string,file_names:array<string>,height:int,width:int,length:int>>,"
    "annotations:array<struct<id:long,video_id:string,category_id:long,bboxes:array<array<double>>,areas:array<double>,iscrowd:int,noun_phrase:string>>,"
    "categories:array<struct<id:long,name:string>>,video_np_pairs:array<struct<id:long,video_id:string,category_id:long,noun_phrase:string,num_masklets:int>>>"
)


def _parts(spark: SparkSession, path: str, schema: str) -> dict[str, DataFrame]:
    whole = materialize(spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d")), "annotations")
    return {f: whole.select(F.explode(f"d.{f}").alias("r")).select("r.*") for f in whole.schema["d"].dataType.fieldNames()}


def read_image_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """images, annotations and categories; crowd annotations are marked `ignored`."""
    parts = _parts(spark, path, IMAGE_SET)
    parts["annotations"] = parts["annotations"].withColumn("ignored", F.coalesce(F.col("iscrowd") == 1, F.lit(False)))
    return parts


def read_video_set(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """videos, annotations, categories and video_np_pairs; video ids are numbers, missing boxes and areas zero in copies."""
    parts = _parts(spark, path, VIDEO_SET)
    parts["videos"] = parts["videos"].withColumn("id", F.col("id").cast("long"))
    for n in ("annotations", "video_np_pairs"):
        parts[n] = parts[n].withColumn("video_id", F.col("video_id").cast("long"))
    zero = F.array(*[F.lit(0.0)] * 4)
    areas = F.filter("areas", lambda a: a.isNotNull())
    parts["annotations"] = parts["annotations"].withColumns({
        "filled_bboxes": F.transform("bboxes", lambda b: F.coalesce(b, zero)), "filled_areas": F.transform("areas", lambda a: F.coalesce(a, F.lit(0.0))),
        "mean_area": F.coalesce(F.aggregate(areas, F.lit(0.0), lambda s, a: s + a) / F.nullif(F.size(areas), F.lit(0)), F.lit(0.0)),
    })
    return parts


def frames_of(annotations: DataFrame, boxes: str = "bboxes", areas: str = "areas") -> DataFrame:
    """One row a visible frame: null or all-zero boxes are invisible; a missing area is width times height."""
    rows = annotations.select("*", F.posexplode(F.arrays_zip(F.col(boxes).alias("b"), F.col(areas).alias("a"))).alias("frame", "z"))
    seen = rows.filter(F.col("z.b").isNotNull() & F.exists("z.b", lambda v: v != 0))
    box = [F.element_at("z.b", i + 1).alias(n) for i, n in enumerate(("x", "y", "w", "h"))]
    area = F.coalesce(F.when(F.col("z.a") > 0, F.col("z.a")), F.element_at("z.b", 3) * F.element_at("z.b", 4)).alias("area")
    return seen.select(*[c for c in annotations.columns if c not in (boxes, areas)], "frame", *box, area)


def load_results(results: DataFrame, images: DataFrame) -> DataFrame:
    """Predictions (image_id, category_id, bbox, score) with area and running ids, after a check of their images."""
    require_subset(results.select(F.col("image_id").alias("id")).distinct(), images.select("id"), ["id"])
    w = Window.partitionBy("image_id").orderBy(F.desc("score"), "category_id")
    return results.withColumns({"area": F.element_at("bbox", 3) * F.element_at("bbox", 4), "iscrowd": F.lit(0), "det": F.row_number().over(w)})


def read_track_text(spark: SparkSession, path: str, separator: str = ",", valid: str | None = None) -> DataFrame:
    """Rows timestep, id, x, y, w, h, score of a text track file; negative ids and rows that fail `valid` go."""
    schema = "timestep int, id long, x double, y double, w double, h double, score double"
    rows = spark.read.csv(path, sep=separator, schema=schema).filter("id >= 0")
    return rows.filter(valid) if valid else rows


def read_trials(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated trials: name, length, fps and a list of labels."""
    raw = spark.read.csv(path, sep="\t", schema="name string, length int, fps double, labels string")
    return raw.withColumn("labels", F.transform(F.split(F.regexp_replace("labels", r"[\[\]\s]", ""), ","), lambda x: x.try_cast("int")))


def last_rows(spark: SparkSession, paths: str) -> DataFrame:
    """(path, value): the last record of each JSON lines file."""
    rows = spark.read.text(paths).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("i"), "value").filter("trim(value) <> ''")
    return rows.groupBy("path").agg(F.max_by("value", "i").alias("value"))


def read_times(spark: SparkSession, path: str) -> DataFrame:
    """(frame, pts) of a probe's CSV of times; empty and N/A are null."""
    rows = spark.read.text(path).select(F.monotonically_increasing_id().alias("i"), F.trim(F.regexp_replace("value", ",.*$", "")).alias("v"))
    return dense_ids(rows, ["i"], "frame", 0).select("frame", F.col("v").try_cast("double").alias("pts"))


def scan_folder(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("mp4", "mkv", "mov", "avi", "webm", "m4v")) -> DataFrame:
    """(name, path): one video a base name, by order of extensions and then of paths. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    parts = files.select("path", F.regexp_extract("path", r"([^/]+)\.([^./]+)$", 1).alias("name"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    ranked = parts.withColumn("rank", F.array_position(F.array(*[F.lit(e) for e in extensions]), F.col("ext"))).filter("rank > 0")
    w = Window.partitionBy("name").orderBy("rank", "path")
    return ranked.withColumn("r", F.row_number().over(w)).filter("r = 1").select("name", "path")


def resolve_video(spark: SparkSession, folder: str, name: str) -> str:
    """The path of one video by its base name, by the order of scan_folder(); none is an error."""
    found = scan_folder(spark, folder).filter(F.col("name") == name).first()
    if found is None:
        raise FileNotFoundError(f"no video {name!r} in {folder}")
    return found["path"]


def crawl_configs(spark: SparkSession, folder: str, filename: str, without: str = "/code/") -> DataFrame:
    """(path) of the files of one name below a folder, less those with a part in their path. File contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", filename).load(folder)
    return files.select("path").filter(~F.contains("path", F.lit(without)))


def read_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at a path, made and written first if it isn't there: a stage's result that a later run takes up again."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
