"""Writers: split lists, detection labels, pairs, scores, metric documents, caches. All write with Spark's writers, to any store."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framesift.sources.vector_files import opened


def split_list(assigned: DataFrame, path: str) -> None:
    assigned.write.mode("overwrite").csv(path, header=True)


def detection_labels(exported: DataFrame, path: str) -> None:
    """One line for each box of status ok (class cx cy w h, six decimals) in folders by split and video."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "w", "h")
    rows = exported.where("status = 'ok'").select("split", "video", F.format_string("%06d %s", F.col("frame"), line).alias("value"))
    rows.write.mode("overwrite").partitionBy("split", "video").text(path)


def detection_dataset(frames: DataFrame, names: list[str], path: str) -> DataFrame:
    """A label file for each frame of status ok under labels/<split>/, and data.yaml; gives split, status, n of the frames.

    frames: as labels.detection_frames gives them. Tasks write the files themselves, each under a name of its own, so a task
    that runs again writes the same ones."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = opened(path)
        for batch in batches:
            for split, stem, lines in zip(batch["split"], batch["stem"], batch["lines"], strict=True):
                store.create_dir(f"{root}/labels/{split}", recursive=True)
                text = "".join(f"{x['class_id']} {x['cx']:.6f} {x['cy']:.6f} {x['w']:.6f} {x['h']:.6f}\n" for x in lines)
                with store.open_output_stream(f"{root}/labels/{split}/{stem}.txt") as f:
                    f.write(text.encode())
            yield pd.DataFrame({"n": [len(batch)]})

    frames.where("status = 'ok'").select("split", "stem", "lines").mapInPandas(write, "n long").agg(F.sum("n")).collect()
    store, root = opened(path)
    store.create_dir(root, recursive=True)
    head = [f"path: {json.dumps(path)}", *(f"{s}: images/{s}" for s in ("train", "val", "test")), "names:"]
    with store.open_output_stream(f"{root}/data.yaml") as f:
        f.write(("\n".join(head + [f"  {i}: {json.dumps(n)}" for i, n in enumerate(names)]) + "\n").encode())
    return frames.groupBy("split", "status").agg(F.count("*").alias("n"))


def pair_index(pairs: DataFrame, factor: float, path: str) -> None:
    """pairs/ with the matches and summary/ with factor, totals and match rate."""
    pairs.where("is_match").select("query", "match").write.mode("overwrite").parquet(f"{path}/pairs")
    rate = F.coalesce(F.avg(F.col("is_match").cast("int")), F.lit(0.0))
    pairs.agg(F.lit(factor).alias("factor"), F.count("*").alias("n_total"), F.count_if("is_match").alias("n_matches"), rate.alias("match_rate")).write.mode("overwrite").json(f"{path}/summary")


def scores(all_scores: DataFrame, peaks: DataFrame, path: str) -> None:
    """scores/ by video, changes/ and stats/."""
    from framesift.operators.temporal import score_stats

    all_scores.write.mode("overwrite").partitionBy("video").parquet(f"{path}/scores")
    peaks.write.mode("overwrite").json(f"{path}/changes")
    score_stats(all_scores).write.mode("overwrite").json(f"{path}/stats")


def filter_report(rows: DataFrame, path: str, distance: str = "distance") -> None:
    """images/ by status with path and distance, and summary/ with the counts. rows: as catalog.filter_report gives them."""
    rows.select("status", "path", distance).write.mode("overwrite").partitionBy("status").json(f"{path}/images")
    rows.agg(F.count("*").alias("n_total"), F.count_if(F.col("status") == "out").alias("n_out"), F.count_if(F.col("status") == "keep").alias("n_keep")).write.mode("overwrite").json(f"{path}/summary")


def path_list(listed: DataFrame, path: str) -> None:
    """listed (nth, path) in order, each path once, where it stands first."""
    from framesift.operators.catalog import first_of_each

    first_of_each(listed, "path", "nth").select("nth", "path").write.mode("overwrite").json(path)


def ranked_splits(best: DataFrame, path: str) -> None:
    """videos/ in folders by rank and part, metrics/ with score and trial of each rank, flags/ with a row for each video and a column for each rank."""
    part = F.when(F.col("is_test"), "test").otherwise("train")
    best.select("rank", part.alias("part"), "video").write.mode("overwrite").partitionBy("rank", "part").csv(f"{path}/videos", header=True)
    best.select("rank", "trial", "score").distinct().write.mode("overwrite").json(f"{path}/metrics")
    split_flags(best).write.mode("overwrite").csv(f"{path}/flags", header=True)


def split_flags(best: DataFrame) -> DataFrame:
    """video and rank_1, ...: 1 where the video is in the test part of that rank."""
    ranks = [r["rank"] for r in best.select("rank").distinct().orderBy("rank").collect()]  # as many as were asked for
    return best.groupBy("video").agg(*(F.max(F.when((F.col("rank") == r) & F.col("is_test"), 1).otherwise(0)).alias(f"rank_{r}") for r in ranks))


def evaluations(spark: SparkSession, evaluators: dict[str, Callable[[], DataFrame]], epoch: int, path: str) -> DataFrame:
    """Run each evaluator (it gives metric, value) and append its rows with epoch and name; one that fails gives a row with its error."""
    done = []
    for name, run in evaluators.items():
        try:
            rows = [(epoch, name, r.metric, float(r.value), None) for r in run().select("metric", "value").collect()]
        except Exception as e:  # whatever an evaluator raises is its result
            rows = [(epoch, name, None, None, f"{type(e).__name__}: {e}"[:500])]
        done += rows
    out = spark.createDataFrame(done, "epoch int, evaluator string, metric string, value double, error string")
    metrics(out, path)
    return out


def metrics(document: DataFrame, path: str) -> None:
    """Append a metric document; documents of one epoch stay side by side."""
    document.write.mode("append").json(path)


def new_features(frames: DataFrame, done: DataFrame, path: str, force: bool = False) -> None:
    """Append what isn't there yet, by video; all of it with force."""
    rows = frames if force else frames.join(done.select("video", "sample_idx"), ["video", "sample_idx"], "left_anti")
    rows.write.mode("overwrite" if force else "append").partitionBy("video").parquet(path)


def annotation_export(boxes: DataFrame, path: str) -> None:
    """One JSON document for each frame: object -> label, box (null out of frame), out_of_frame. boxes: with oof."""
    value = F.struct("label", F.when(~F.col("oof"), F.array("x1", "y1", "x2", "y2")).alias("bbox"), F.col("oof").alias("out_of_frame"))
    rows = boxes.groupBy("video", "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.col("oid").cast("string").alias("k"), value.alias("v")))).alias("objects"))
    rows.write.mode("overwrite").json(path)


def edit_log(events: DataFrame, path: str) -> None:
    """Append events (operators.edits) in folders by video. A write that is repeated changes nothing, as the last writer counts by number."""
    events.where("video is not null").write.mode("append").partitionBy("video").parquet(path)


def tracker_states(states: DataFrame, path: str) -> None:
    """One JSON document for each video, in a folder of its own; other videos' folders stay. states: as edits.states gives them."""
    from framesift.operators.edits import STATE

    fields = [f.split(" ", 1)[0] for f in re.split(r", (?=\w+ )", STATE)]
    document = F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})
    states.select("video", document.alias("value")).repartition("video").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").text(path)


def without(rows: DataFrame, listed: DataFrame, key: str = "path") -> tuple[DataFrame, DataFrame]:
    """The rows not listed, and the videos that lost some."""
    lost = rows.join(listed.select(key).distinct(), key, "left_semi").select("video").distinct()
    return rows.join(listed.select(key).distinct(), key, "left_anti"), lost


def unique_names(rows: DataFrame) -> DataFrame:
    """rows (path, distance) with the flat name of a copy: folder_stem_dist<distance>.suffix; equal names are numbered from the second on, by path."""
    p = F.split("path", "/")
    file, folder = F.element_at(p, -1), F.coalesce(F.try_element_at(p, F.lit(-2)), F.lit(""))
    suffix = F.regexp_substr(file, F.lit(r"(?<=.)\.[^.]+$"))
    stem = F.when(suffix.isNull(), file).otherwise(F.substring(file, F.lit(1), F.length(file) - F.length(suffix)))
    name = rows.withColumns({"_name": F.concat(folder, F.lit("_"), stem, F.format_string("_dist%.4f", F.col("distance").cast("double"))), "_suffix": F.coalesce(suffix, F.lit(""))})
    nth = F.row_number().over(Window.partitionBy("_name", "_suffix").orderBy("path")) - 1
    return name.withColumn("name", F.concat("_name", F.when(nth > 0, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), "_suffix")).drop("_name", "_suffix")


def copies(named: DataFrame, path: str) -> DataFrame:
    """Copy each file of named (path, name) to path/name in tasks; gives path, name, copied: false where there is no such file."""

    def copy(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, root = opened(path)
        out.create_dir(root, recursive=True)
        for batch in batches:
            done = []
            for source, name in zip(batch["path"], batch["name"], strict=True):
                try:
                    store, at = opened(source)
                    with store.open_input_stream(at) as a, out.open_output_stream(f"{root}/{name}") as b:
                        while block := a.read(1 << 20):
                            b.write(block)
                    done.append(True)
                except FileNotFoundError:
                    done.append(False)
            yield batch.assign(copied=done)

    return named.select("path", "name").mapInPandas(copy, "path string, name string, copied boolean")
