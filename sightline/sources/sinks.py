"""Writers: subtitles, prediction dumps, result tables and the stage log."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import text as tx

# The sections and fields that players expect of a subtitle script.
INFO = ["[Script Info]", "ScriptType: v4.00+", "WrapStyle: 0", "ScaledBorderAndShadow: yes", "YCbCr Matrix: TV.601", "PlayResX: 1280", "PlayResY: 720"]
STYLE_FIELDS = (
    "Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, "
    "ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding"
)
STYLE = "{name},{font},42,{colour},&H000000FF,&H00202020,&H00000000,0,0,0,0,100,100,0,0,1,2,0,2,30,30,30,1"
EVENT_FIELDS = "Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text"


def header(styles: dict[str, str], font: str = "Noto Sans CJK SC") -> list[str]:
    """The lines before the dialogue: a style for each name, in the colour given as &HAABBGGRR."""
    rows = [f"Style: {STYLE.format(name=n, font=font, colour=c)}" for n, c in {"Default": "&H00FFFFFF", **styles}.items()]
    return [*INFO, "", "[V4+ Styles]", f"Format: {STYLE_FIELDS}", *rows, "", "[Events]", f"Format: {EVENT_FIELDS}"]


def dialogue(lines: DataFrame) -> DataFrame:
    """(start_s, end_s, style, text) as Dialogue rows in order."""
    row = F.concat(F.lit("Dialogue: 0,"), tx.ass_time(F.col("start_s")), F.lit(","), tx.ass_time(F.col("end_s")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), tx.escape_braces(F.col("text")))
    return lines.orderBy("start_s", "end_s", "style", "text").select(row.alias("value"))


def sliced(segments: DataFrame) -> DataFrame:
    """Each wrapped line of a segment with an equal slice of its time."""
    rows = segments.select("*", tx.wrap_subtitle(F.col("text")).alias("_lines")).select("*", F.posexplode("_lines").alias("_i", "_line"))
    step = (F.col("end_s") - F.col("start_s")) / F.size("_lines")
    start = F.col("start_s") + F.col("_i") * step
    return rows.withColumns({"text": F.col("_line"), "end_s": start + step, "start_s": start}).drop("_lines", "_i", "_line")


def word_lines(segments: DataFrame, width: int = tx.LATIN_WIDTH) -> DataFrame:
    """Lines timed by their words: segments (seg_id, style, words array<struct<start,end,word>>), greedy by width."""
    begin = F.struct(F.lit(0).alias("line"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("of"))

    def step(acc, w):
        n = F.length(w["word"])
        fits = (acc["used"] == 0) | (acc["used"] + 1 + n <= width)
        line = F.when(fits, acc["line"]).otherwise(acc["line"] + 1)
        used = F.when(fits & (acc["used"] > 0), acc["used"] + 1 + n).otherwise(n)
        return F.struct(line.alias("line"), used.alias("used"), F.concat(acc["of"], F.array(line)).alias("of"))

    numbered = segments.withColumn("_of", F.aggregate("words", begin, step, lambda a: a["of"]))
    rows = numbered.select("seg_id", "style", F.posexplode(F.arrays_zip(F.col("words").alias("w"), F.col("_of").alias("l"))).alias("i", "z"))
    g = rows.groupBy("seg_id", "style", F.col("z.l").alias("line"))
    return g.agg(F.min("z.w.start").alias("start_s"), F.max("z.w.end").alias("end_s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "z.w.word"))), lambda x: x["word"]), " ").alias("text"))


def write_subtitles(lines: DataFrame, path: str, colours: dict[str, str] | None = None) -> None:
    """One subtitle file; subtitles of one video are few, so a single ordered part is meant here.

    colours are those of the styles by name; styles without one are white.
    """
    spark = lines.sparkSession
    named = {r["style"]: (colours or {}).get(r["style"], "&H00FFFFFF") for r in lines.select("style").distinct().orderBy("style").collect()}
    top = header(named)
    head = spark.createDataFrame([(i - len(top), h) for i, h in enumerate(top)], "i long, value string")
    body = dialogue(lines).withColumn("i", F.monotonically_increasing_id())
    head.union(body.select("i", "value")).coalesce(1).sortWithinPartitions("i").select("value").write.mode("overwrite").text(path)


def write_predictions(dets: DataFrame, path: str) -> None:
    """(image_id, category_id, bbox, score) as JSON lines with five decimals."""
    five = lambda c: F.rint(c * 100000) / 100000
    dets.select("image_id", "category_id", F.transform("bbox", five).alias("bbox"), five(F.col("score")).alias("score")).write.mode("overwrite").json(path)


def write_video_results(masks: DataFrame, path: str) -> None:
    """Tracks of videos as JSON lines: rows (video_id, category_id, track_id, frame, score, counts, height, width) and lengths.

    Each line is a track: its mean score and its segmentations by frame, null where it isn't seen. `length` is the video's.
    """
    seen = masks.select("video_id", "category_id", "track_id", "length", "frame", "score", F.struct(F.array("height", "width").alias("size"), "counts").alias("segmentation"))
    rows = seen.groupBy("video_id", "category_id", "track_id", "length").agg(F.avg("score").alias("score"), F.map_from_entries(F.collect_list(F.struct("frame", "segmentation"))).alias("m"))
    frames = F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda f: F.try_element_at("m", f.cast("int")))
    rows.select("video_id", "category_id", "score", frames.alias("segmentations")).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_results(fields: DataFrame, path: str) -> None:
    """A long result table (seq, cls, field, value) as CSV, one column a field."""
    fields.groupBy("seq", "cls").pivot("field").agg(F.first("value")).write.mode("overwrite").option("header", True).csv(path)


def write_details(fields: DataFrame, path: str) -> None:
    """The same table in full: one row a sequence, class and field with its values by threshold, as JSON lines."""
    values = F.transform(F.array_sort(F.collect_list(F.struct("level", "value"))), lambda x: x["value"])
    fields.groupBy("seq", "cls", "field").agg(values.alias("values")).write.mode("overwrite").json(path)


@contextmanager
def stage(spark: SparkSession, name: str, path: str) -> Iterator[None]:
    """Append how long a stage took to a JSON table; a failure to write is no failure of the stage."""
    start = time.time()
    try:
        yield
    finally:
        row = [(name, start, time.time(), time.time() - start)]
        try:
            spark.createDataFrame(row, "stage string, ts_start double, ts_end double, elapsed_sec double").write.mode("append").json(path)
        except Exception as e:  # the log is a by-product
            print(f"stage log: {e}")
