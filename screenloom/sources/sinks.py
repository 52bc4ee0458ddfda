"""Sinks: JSON and JSON lines, label files, groups, reports and run names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """JSON lines, in folders of ``partition_by``; Spark's commit protocol replaces renames of single files."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).json(path)


def write_texts(df: DataFrame, path: str, text: str, partition_by: list[str]) -> None:
    df.select(*partition_by, F.col(text).alias("value")).write.mode("overwrite").partitionBy(*partition_by).text(path)


def write_groups(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_report(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def triplets(elements: DataFrame, ocr: DataFrame, keys: list[str]) -> DataFrame:
    """keys, element_index, bbox_ltrb, type, text, tag, role: an element without text takes that of its OCR result."""
    joined = elements.join(ocr.select(*keys, "seq", F.col("text").alias("_ocr")), [*keys, "seq"], "left")
    own = F.nullif(F.trim(F.coalesce("inner_text", F.lit(""))), F.lit(""))
    x, y, w, h = (F.col(c) for c in "xywh")
    return joined.select(*keys, F.col("seq").alias("element_index"), F.array(x, y, x + w, y + h).alias("bbox_ltrb"), "type", F.coalesce(own, F.trim("_ocr"), F.lit("")).alias("text"), "tag", "role")


def prediction_json(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, elements: a sample's elements (seq, box, label, text, score) as one JSON list in order."""
    el = F.struct("seq", F.struct(F.struct("x", "y", "w", "h").alias("bbox"), "label", "text", "score").alias("e"))
    return df.groupBy(*keys).agg(F.to_json(F.transform(F.array_sort(F.collect_list(el)), lambda v: v["e"])).alias("elements"))


def slug(c: Column, most: int = 24) -> Column:
    """Lower case with one hyphen for each run of other signs than a-z and 0-9, none at the ends, ``most`` characters;
    ``unknown`` if nothing is left."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", "-"), "^-|-$", "")
    return F.when(plain == "", F.lit("unknown")).otherwise(F.substring(plain, 1, most))


def models_token(names: Column) -> Column:
    """The slugs of an array of names with + between, five at most and then how many more; empty names don't count."""
    some = F.filter(names, lambda x: x != "")
    shown = F.array_join(F.transform(F.slice(some, 1, 5), lambda x: slug(x, 20)), "+")
    return F.when(F.coalesce(F.size(some), F.lit(0)) <= 0, F.lit("model")).when(F.size(some) > 5, F.concat_ws("+", shown, F.size(some) - 5)).otherwise(shown)


def dataset_token(root: Column, short: str, known: str | None = None, split: Column | None = None, tag: Column | None = None) -> Column:
    """``short`` and the slug of the root's last name, or ``short`` alone if that holds ``known``; a split other than all
    stands for the name; a tag follows."""
    name = slug(F.element_at(F.split(F.regexp_replace(root, "/+$", ""), "/"), -1), 16)
    base = F.when(name.contains(known), F.lit(short)).otherwise(F.concat_ws("-", F.lit(short), name)) if known else F.concat_ws("-", F.lit(short), name)
    if split is not None:
        base = F.when(F.lower(split) != "all", F.concat_ws("-", F.lit(short), F.lower(split))).otherwise(base)
    return base if tag is None else F.when(F.coalesce(tag, F.lit("")) != "", F.concat_ws("-", base, slug(tag, 8))).otherwise(base)


def run_id(models: Column, rows: Column, dataset: Column, schema: Column) -> Column:
    """The name of a run by its models, number of samples, data set token and schema token."""
    return F.concat(F.lit("m"), F.greatest(F.coalesce(F.size(models), F.lit(0)), F.lit(0)), F.lit("-"), models_token(models), F.lit("_n"), rows, F.lit("_ds-"), dataset, F.lit("_map-"), schema)
