"""Command line over Parquet folders: python -m screenloom.cli COMMAND --in ... --out ...

Element tables have screen_id, seq, x, y, w, h and what a command needs of tag, role, type, label, attrs, aria_hidden,
inner_text, parent; label tables have split, stem, text; image hashes have image_path, hash.
"""

from __future__ import annotations

import argparse
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import dedupe, export, filters, hierarchy, metrics, model_io, validate
from .schema import QUALITY, VIEWPORT_H, VIEWPORT_W
from .sources import readers

KEY = ["screen_id"]


def _metrics(gt: DataFrame, pred: DataFrame, a) -> DataFrame:
    """metric and value over all samples, as the measures asked for define their means."""
    one = lambda df, value: df.agg(value.alias("value"))

    def page():
        return metrics.page_cells(gt, pred, KEY, a.width, a.height, a.resolution)

    def mean_ap():
        totals = gt.where("label <> ''").groupBy("label").agg(F.count("*").alias("n_gt"))
        ap = metrics.average_precision(metrics.matches(gt, pred, KEY, a.iou), totals, ["label"], [*KEY, "seq"])
        return one(ap.where("n_gt > 0"), F.avg("ap"))

    made = {
        "page_iou": lambda: one(page(), F.avg(F.col("inter") / F.col("n_union"))),
        "page_recall": lambda: one(page().where("n_gt > 0"), F.avg(F.col("inter") / F.col("n_gt"))),
        "label_page_iou": lambda: one(metrics.label_cells(gt, pred, KEY, a.width, a.height, a.resolution).where("n_union > 0"), F.avg(F.col("match") / F.col("n_union"))),
        "map": mean_ap,
        "recall_label": lambda: one(metrics.recall(gt, pred, KEY, a.iou, True), F.sum("tp") / F.sum("n_gt")),
        "recall_any": lambda: one(metrics.recall(gt, pred, KEY, a.iou, False), F.sum("tp") / F.sum("n_gt")),
        "ned": lambda: one(metrics.edit_distances(gt, pred, KEY, a.ned_iou), F.sum("cost") / F.sum("n_gt")),
    }
    asked = metrics.measures_of(a.metrics) if a.metrics else list(made)
    if not asked:
        raise SystemExit("no known metric")
    return reduce(DataFrame.unionByName, [made[m]().select(F.lit(m).alias("metric"), "value") for m in asked])


def named(specs: list[str]) -> list[tuple[str, str]]:
    """(name, path) of each NAME=PATH; a path alone is named by its last folder. A name given twice is an error."""
    out = [tuple(s.split("=", 1)) if "=" in s.split("/")[0] else (s.rstrip("/").rsplit("/", 1)[-1], s) for s in specs]
    if len({n for n, _ in out}) < len(out):
        raise SystemExit(f"a name is given twice: {' '.join(n for n, _ in out)}")
    return out


def _matrix(spark: SparkSession, a) -> DataFrame:
    """dataset, model, metric, value of every model on every data set; {dataset} in a model's path is the data set's name."""
    parts = []
    for dataset, path in named(a.source):
        gt = spark.read.parquet(path)
        for model, at in named(a.predictions):
            got = _metrics(gt, spark.read.parquet(at.replace("{dataset}", dataset)), a)
            parts.append(got.select(F.lit(dataset).alias("dataset"), F.lit(model).alias("model"), "metric", "value"))
    return reduce(DataFrame.unionByName, parts)


def build(spark: SparkSession, a) -> DataFrame:
    if a.command == "evaluate":
        if not a.predictions:
            raise SystemExit("evaluate needs --predictions")
        return _metrics(spark.read.parquet(a.source[0]), spark.read.parquet(a.predictions[0]), a) if len(a.source) == len(a.predictions) == 1 and "=" not in a.source[0] + a.predictions[0] else _matrix(spark, a)
    df = spark.read.parquet(*a.source)
    if a.command == "dom":
        return readers.dom_elements(df, "page_id")
    if a.command == "filter":
        return filters.filter_elements(df, KEY, max_area=a.width * a.height)
    if a.command == "hierarchy":
        return hierarchy.parents(df, KEY, a.containment, semantic=not a.no_semantic_hints)
    if a.command == "own-text":
        return hierarchy.own_texts(df, KEY)
    if a.command == "markup":
        return hierarchy.serialize(df, KEY, a.width, a.height)
    if a.command == "dedupe":
        return dedupe.duplicate_groups(df, "image_path", radius=a.threshold)
    if a.command == "export":
        return export.labels(df, "screen_id", a.width, a.height, tuple(a.ratios), a.seed)
    if a.command == "validate":
        return validate.report(df.select("split", "stem"), df.where("text IS NOT NULL"))
    return model_io.quality_scores(df, "image_path", "answer", a.quality)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("command", choices=("dom", "filter", "hierarchy", "own-text", "markup", "dedupe", "export", "validate", "score", "evaluate"))
    p.add_argument("--in", dest="source", required=True, nargs="+", help="a folder; for evaluate one or more, each as NAME=PATH")
    p.add_argument("--out", required=True)
    p.add_argument("--predictions", nargs="+", help="a folder, or one or more as NAME=PATH")
    p.add_argument("--metrics", nargs="+", help="names of measures; all if not given")
    p.add_argument("--width", type=int, default=VIEWPORT_W)
    p.add_argument("--height", type=int, default=VIEWPORT_H)
    p.add_argument("--containment", type=float, default=0.95)
    p.add_argument("--no-semantic-hints", action="store_true")
    p.add_argument("--threshold", type=int, default=8)
    p.add_argument("--ratios", type=float, nargs=3, default=(0.9, 0.05, 0.05))
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--quality", type=float, default=QUALITY)
    p.add_argument("--iou", type=float, default=0.5)
    p.add_argument("--ned-iou", type=float, default=0.0)
    p.add_argument("--resolution", type=int, default=0)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("screenloom").getOrCreate()
    build(spark, a).write.mode("overwrite").parquet(a.out)


if __name__ == "__main__":
    main()
