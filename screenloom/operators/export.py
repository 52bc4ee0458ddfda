"""Export of detection labels: classes, unit boxes, duplicates, splits, label files and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamp
from ..functions.labels import class_id, export_class
from ..functions.urls import split_of
from ..schema import CLASSES, CONTAINERS, NON_NESTABLE
from .suppression import clean_boxes


def unit_box(width, height) -> dict[str, Column]:
    """Centre and size as shares of the image, each clamped to 0..1 by itself."""
    x, y, w, h = (F.col(c) for c in "xywh")
    one = lambda v: clamp(v, 0.0, 1.0)
    return {"cx": one((x + w / 2) / width), "cy": one((y + h / 2) / height), "bw": one(w / width), "bh": one(h / height)}


def labels(df: DataFrame, screen: str, width: int, height: int, ratios=(0.7, 0.2, 0.1), seed: int = 42, clean: bool = True) -> DataFrame:
    """screen, seq, split, class_id, class_name, cx, cy, bw, bh of rows (screen, seq, box, label, type) with a size."""
    name = export_class(F.col("label"), F.col("type"))
    rows = df.where("w > 0 AND h > 0").withColumns({"class_name": name, "split": split_of(F.col(screen).cast("string"), *ratios, seed), **unit_box(width, height)})
    rows = rows.withColumn("class_id", class_id(F.col("class_name"))).select(screen, "seq", "split", "class_id", "class_name", "cx", "cy", "bw", "bh")
    if not clean:
        return rows
    half = lambda c, s, sign: F.col(c) + sign * F.col(s) / 2
    flat = rows.select(screen, "seq", F.col("class_id").alias("cls"), half("cx", "bw", -1).alias("x1"), half("cy", "bh", -1).alias("y1"), half("cx", "bw", 1).alias("x2"), half("cy", "bh", 1).alias("y2"), F.col("class_name").isin(*CONTAINERS).alias("container"), F.col("class_name").isin(*NON_NESTABLE).alias("non_nestable"))
    return rows.join(clean_boxes(flat, [screen]).select(screen, "seq"), [screen, "seq"], "left_semi")


def label_files(df: DataFrame, screen: str) -> DataFrame:
    """screen, split, text: a screen's label lines in order, six decimals."""
    line = F.format_string("%d %.6f %.6f %.6f %.6f", "class_id", "cx", "cy", "bw", "bh")
    lists = df.groupBy(screen, "split").agg(F.array_sort(F.collect_list(F.struct("seq", line.alias("line")))).alias("l"))
    return lists.select(screen, "split", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("text"))


def class_stats(df: DataFrame) -> DataFrame:
    """split, class_name, n and its share (per cent) of the split; classes without rows are left out."""
    counts = df.groupBy("split", "class_name").agg(F.count("*").alias("n"))
    return counts.withColumn("share_pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("split")), 4))


def split_stats(df: DataFrame, screen: str) -> DataFrame:
    """split (null: all), n_screens, n_labels in one pass by grouping sets."""
    return df.rollup("split").agg(F.countDistinct(screen).alias("n_screens"), F.count("*").alias("n_labels"))


def class_list() -> str:
    return "\n".join(CLASSES)


def data_yaml(root: str) -> str:
    return "\n".join([f"path: {root}", "train: images/train", "val: images/val", "test: images/test", f"nc: {len(CLASSES)}", "names:", *[f"  {i}: {c}" for i, c in enumerate(CLASSES)], ""])
