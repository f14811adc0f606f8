"""Label files: phase sequences, tracker states, tables of tools and phases, detection lines, split lists, predictions, workbooks."""

from __future__ import annotations

import io
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.functions import names

_SEQUENCES = "sequences array<struct<videoId:string,videoAnnotations:array<struct<label:struct<displayName:string,code:string>,timestampStart:bigint,timestampEnd:bigint>>>>"


def phase_sequences(spark: SparkSession, path: str) -> DataFrame:
    """uuid (lower case), pos, label, code, start_ms, end_ms of all intervals; an empty sequence gives none. Sorted by start within a video."""
    s = spark.read.schema(_SEQUENCES).json(path, multiLine=True).select(F.explode("sequences").alias("s"))
    a = s.select(F.lower("s.videoId").alias("uuid"), F.explode("s.videoAnnotations").alias("a"))
    rows = a.select("uuid", F.col("a.label.displayName").alias("label"), F.col("a.label.code").alias("code"), F.col("a.timestampStart").alias("start_ms"), F.col("a.timestampEnd").alias("end_ms"))
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("uuid").orderBy("start_ms", "end_ms", "code")) - 1)


def seconds(intervals: DataFrame) -> DataFrame:
    """start_s, end_s of start_ms, end_ms, rounded down."""
    return intervals.withColumns({"start_s": F.floor(F.col("start_ms") / 1000), "end_s": F.floor(F.col("end_ms") / 1000)})


def workbook(spark: SparkSession, path: str) -> DataFrame:
    """sheet, sheet_no, row_no, cells (text) of the .xlsx files at a path."""

    def load(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = [(name, k, r, cells) for k, (name, lines) in enumerate(_sheets(content)) for r, cells in enumerate(lines)]
                yield pd.DataFrame(rows, columns=["sheet", "sheet_no", "row_no", "cells"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(load, "sheet string, sheet_no int, row_no int, cells array<string>")


def _sheets(content: bytes) -> Iterator[tuple[str, list[list[str | None]]]]:
    n = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = ["".join(t.text or "" for t in s.iter(f"{{{n['m']}}}t")) for s in ET.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", n)] if "xl/sharedStrings.xml" in z.namelist() else []
        titles = [s.get("name") for s in ET.fromstring(z.read("xl/workbook.xml")).findall("m:sheets/m:sheet", n)]
        for k, title in enumerate(titles, 1):
            lines = []
            for row in ET.fromstring(z.read(f"xl/worksheets/sheet{k}.xml")).findall("m:sheetData/m:row", n):
                cells: list[str | None] = []
                for c in row.findall("m:c", n):
                    column = 0
                    for letter in re.match("[A-Z]+", c.get("r"))[0]:
                        column = column * 26 + ord(letter) - 64
                    cells += [None] * (column - 1 - len(cells))
                    value = c.findtext("m:v", None, n)
                    text = shared[int(value)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{{{n['m']}}}t")) if c.get("t") == "inlineStr" else value
                    cells.append(text)
                lines.append(cells)
            yield title, lines


def uuid_table(rows: DataFrame) -> DataFrame:
    """uuid, name, sheet: the first UUID of each workbook row; the first sheet wins, then the first row. The name is the first other filled cell."""
    text = F.array_join(F.filter("cells", lambda c: c.isNotNull()), " ")
    found = rows.withColumn("uuid", names.uuid(text)).where("uuid is not null")
    name = F.get(F.filter("cells", lambda c: c.isNotNull() & (F.trim(c) != "") & ~F.contains(F.lower(c), F.col("uuid"))), 0)
    best = F.min(F.struct("sheet_no", "row_no", name.alias("name"), "sheet"))
    return found.groupBy("uuid").agg(best.alias("b")).select("uuid", "b.name", "b.sheet")


_STATE = "objects map<string,struct<label:string,box:array<double>,n_blobs:int,obj_start:int,obj_end:int>>, bboxes map<string,map<string,array<int>>>, review_marks array<int>, blurry_ranges array<array<int>>"


def tracker_states(spark: SparkSession, path: str) -> DataFrame:
    """video (the folder of the file), objects, bboxes, review_marks, blurry_ranges, oof (variant) of each state file."""
    raw = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("video"), "value")
    return raw.select("video", F.from_json("value", _STATE).alias("s"), F.try_variant_get(F.try_parse_json("value"), "$.oof", "variant").alias("oof")).select("video", "s.*", "oof")


def saved_states(spark: SparkSession, path: str) -> DataFrame:
    """video and state (operators.edits) of what sinks.tracker_states wrote; a document that can't be read has nulls."""
    from framesift.operators.edits import STATE

    raw = spark.read.schema("value string, video string").text(path, wholetext=True)
    return raw.select("video", F.from_json("value", STATE).alias("s")).select("video", "s.*")


def edit_log(spark: SparkSession, path: str) -> DataFrame:
    """The events that sinks.edit_log wrote."""
    from framesift.operators.edits import EVENTS

    return spark.read.schema(EVENTS).parquet(path)


def out_of_frame(states: DataFrame, points: bool = False) -> DataFrame:
    """video, oid, start, end (null: open) from each of the three encodings: a list of [frame, object], a map from object to frame,
    a map from object to ranges. points: a list entry is that one frame; else it opens a range, and the last entry of an object counts."""
    text = F.to_json("oof")
    pairs = F.from_json(text, "array<array<int>>")
    single = F.from_json(text, "map<string,int>")
    ranges = F.from_json(text, "map<string,array<array<int>>>")
    kind = F.when(text.startswith("["), "list").when(F.regexp_like(text, F.lit(r'^\{"[^"]*":\[')), "ranges").when(text.startswith("{"), "single")
    held = states.select("video", "oof", kind.alias("kind"))
    listed = held.where("kind = 'list'").select("video", F.posexplode(pairs).alias("pos", "p")).select("video", "pos", F.get("p", 1).cast("string").alias("oid"), F.get("p", 0).alias("start"))
    if points:
        listed = listed.select("video", "oid", "start", F.col("start").alias("end"))
    else:
        listed = listed.groupBy("video", "oid").agg(F.max_by("start", "pos").alias("start")).select("video", "oid", "start", F.lit(None).cast("int").alias("end"))
    one = held.where("kind = 'single'").select("video", F.explode(single).alias("oid", "start")).select("video", "oid", "start", F.lit(None).cast("int").alias("end"))
    many = held.where("kind = 'ranges'").select("video", F.explode(ranges).alias("oid", "r")).select("video", "oid", F.explode("r").alias("r")).select("video", "oid", F.get("r", 0).alias("start"), F.get("r", 1).alias("end"))
    return listed.unionByName(one).unionByName(many)


def annotations(states: DataFrame, closed: bool = True) -> DataFrame:
    """video, frame, boxes (label, oid, box), hidden (object ids out of frame) of each frame; null boxes and unknown objects are skipped,
    boxes out of frame are left out but named, frames without boxes stay."""
    from framesift.functions.boxes import in_ranges

    own = out_of_frame(states).groupBy("video", "oid").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    frames = states.select("video", "objects", F.explode("bboxes").alias("frame", "b")).withColumn("frame", F.col("frame").cast("int"))
    each = frames.select("video", "frame", "objects", F.explode_outer("b").alias("oid", "box")).withColumn("label", F.try_element_at("objects", F.col("oid"))["label"])
    each = each.join(own, ["video", "oid"], "left")
    real = F.col("box").isNotNull() & F.col("label").isNotNull()
    away = F.coalesce(in_ranges(F.col("ranges"), F.col("frame"), closed), F.lit(False))
    return each.groupBy("video", "frame").agg(
        F.array_sort(F.collect_list(F.when(real & ~away, F.struct("oid", "label", "box")))).alias("boxes"), F.array_sort(F.collect_set(F.when(real & away, F.col("oid")))).alias("hidden")
    )


def tsv(spark: SparkSession, path: str) -> DataFrame:
    """line, cells of a tab-separated file: byte order mark and blank lines gone. Cells are as the line has them; see `table`."""
    text = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), r"\r?\n")).alias("line", "value"))
    return text.where(F.trim("value") != "").select("line", F.split("value", "\t").alias("cells"))


def table(rows: DataFrame, header: list[str]) -> DataFrame:
    """The lines after the first as columns: short rows are filled with empty cells, long ones cut."""
    first = rows.agg(F.min("line").alias("first"))
    body = rows.join(F.broadcast(first)).where(F.col("line") > F.col("first"))
    return body.select("line", *(F.coalesce(F.get("cells", i), F.lit("")).alias(c) for i, c in enumerate(header)))


def tool_totals(tools: DataFrame, labels: list[str]) -> DataFrame:
    """label, total of the cells that are numbers."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.expr(f"try_cast(`{c}` as double)").alias("v")) for c in labels)))
    return tools.select(pairs.alias("p")).groupBy("p.label").agg(F.coalesce(F.sum("p.v"), F.lit(0.0)).alias("total"))


def detection_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, class_id, cx, cy, w, h of lines with five numbers at least; others are skipped."""
    return detection_rows(spark.read.text(path).select(F.input_file_name().alias("file"), "value"))


def detection_rows(lines: DataFrame) -> DataFrame:
    """The same from lines (file, value)."""
    num = [F.get("p", i).try_cast("double") for i in range(1, 5)]
    rows = lines.select("file", F.split(F.trim("value"), r"\s+").alias("p")).where(F.size("p") >= 5)
    out = rows.select("file", F.get("p", 0).try_cast("int").alias("class_id"), *(c.alias(n) for c, n in zip(num, ("cx", "cy", "w", "h"), strict=True)))
    return out.dropna(subset=["class_id", "cx", "cy", "w", "h"])


def split_list(spark: SparkSession, path: str) -> DataFrame:
    """video, dataset, split, n_frames of a split file; rows with an unknown split are ignored."""
    rows = spark.read.csv(path, header=True)
    return rows.where(F.col("split").isin("train", "val", "test"))


def exclusions(spark: SparkSession, path: str) -> DataFrame:
    """frame: all frames of lines `start end` (both included); what follows # is a comment, other lines are skipped."""
    p = F.split(F.trim(F.regexp_replace("value", "#.*", "")), r"\s+")
    rows = spark.read.text(path).select(F.get(p, 0).try_cast("int").alias("a"), F.get(p, 1).try_cast("int").alias("b"))
    return rows.where("a <= b").select(F.explode(F.sequence("a", "b")).alias("frame")).distinct()


def predictions(spark: SparkSession, path: str, phases: int) -> DataFrame:
    """frame, phase_1.. of a prediction file: a map from frame name to scores; frames without scores are left out."""
    return prediction_rows(spark.read.text(path, wholetext=True), phases)


def prediction_rows(documents: DataFrame, phases: int) -> DataFrame:
    """The same from documents (value)."""
    raw = documents.select(F.from_json("value", "map<string,struct<phases_score_dist:array<double>>>").alias("m"))
    each = raw.select(F.explode("m").alias("frame", "v")).where("v.phases_score_dist is not null")
    return each.select("frame", *(F.get("v.phases_score_dist", i).alias(f"phase_{i + 1}") for i in range(phases)))


def metric_series(spark: SparkSession, path: str, metric: str) -> DataFrame:
    """epoch, value of one metric by path (evaluator.name) in metric documents; null where it isn't there."""
    return metric_values(spark.read.text(path, wholetext=True), metric)


def metric_values(documents: DataFrame, metric: str) -> DataFrame:
    """The same from documents (value)."""
    raw = documents.select(F.try_parse_json("value").alias("v"))
    return raw.select(F.try_variant_get("v", "$.epoch", "int").alias("epoch"), F.try_variant_get("v", f"$.metrics.{metric}", "double").alias("value"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, embedding of a manifest file; a file without a column for either is an error."""
    return manifest_rows(spark.read.csv(path, header=True))


def manifest_rows(rows: DataFrame) -> DataFrame:
    """video_id (videoNN) and embedding (its path) from the columns video_id or video_idx, and embedding or embedding_path."""
    video = next((c for c in ("video_id", "video_idx") if c in rows.columns), None)
    path = next((c for c in ("embedding", "embedding_path") if c in rows.columns), None)
    if not video or not path:
        raise ValueError("a manifest needs video_id or video_idx, and embedding or embedding_path")
    text = F.col(video).cast("string")
    digits = F.regexp_replace(text, r"\D", "")
    named = F.when(digits == "", text).otherwise(names.numbered(digits.try_cast("long")))
    return rows.select(F.when(F.lower(text).startswith("video"), named).otherwise(names.numbered(text.try_cast("double").cast("long"))).alias("video_id"), F.col(path).alias("embedding"))


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """nth, path of a list of paths ({"paths": [...]}); an empty list, or none in the file, gives no rows."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "paths array<string>").alias("p"))
    return raw.select(F.posexplode("p.paths").alias("nth", "path"))
