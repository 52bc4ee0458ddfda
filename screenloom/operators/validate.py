"""Checks of exported label files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import CLASSES


def label_lines(files: DataFrame) -> DataFrame:
    """split, stem, line_no (from 1) and line of every non-blank line of (split, stem, text)."""
    lines = files.select("split", "stem", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("i", "line"))
    return lines.select("split", "stem", (F.col("i") + 1).alias("line_no"), strip(F.col("line")).alias("line")).where("line <> ''")


def checked(files: DataFrame) -> DataFrame:
    """Each line with its issue: values, parse, class, box or none; n_tokens, class_id and the four numbers where they parse.

    Every line is judged on its own; one with a class out of range doesn't end its file.
    """
    parts = F.split("line", r"\s+")
    num = lambda k: parts[k].try_cast("double")
    rows = label_lines(files).withColumn("n_tokens", F.size(parts)).withColumns({"class_id": F.when(F.col("n_tokens") == 5, parts[0].try_cast("int")), **{c: F.when(F.col("n_tokens") == 5, num(k + 1)) for k, c in enumerate(("cx", "cy", "bw", "bh"))}})
    unread = F.col("class_id").isNull() | F.col("cx").isNull() | F.col("cy").isNull() | F.col("bw").isNull() | F.col("bh").isNull()
    inside = F.col("cx").between(0, 1) & F.col("cy").between(0, 1) & (F.col("bw") > 0) & (F.col("bw") <= 1) & (F.col("bh") > 0) & (F.col("bh") <= 1)
    issue = F.when(F.col("n_tokens") != 5, "values").when(unread, "parse").when(~F.col("class_id").between(0, len(CLASSES) - 1), "class").when(~inside, "box").otherwise("none")
    return rows.withColumn("issue", issue)


def report(images: DataFrame, files: DataFrame) -> DataFrame:
    """split (null: all), n_images, n_missing, n_annotations, n_invalid, n_box, avg_boxes."""
    lines = checked(files).groupBy("split", "stem").agg(F.sum(F.when(~F.col("issue").isin("values", "parse"), 1).otherwise(0)).alias("ann"), F.sum(F.when(F.col("issue").isin("values", "parse", "class"), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("issue") == "box", 1).otherwise(0)).alias("box"))
    had = files.select("split", "stem", F.lit(1).alias("had"))
    by = images.join(had, ["split", "stem"], "left").join(lines, ["split", "stem"], "left")
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    out = by.rollup("split").agg(F.count("*").alias("n_images"), F.sum(F.when(F.col("had").isNull(), 1).otherwise(0)).alias("n_missing"), zero("ann").alias("n_annotations"), zero("bad").alias("n_invalid"), zero("box").alias("n_box"))
    return out.withColumn("avg_boxes", F.round(F.col("n_annotations") / F.greatest("n_images", F.lit(1)), 6))


#: Keys that a data set's configuration must have, and those that name a split's folder.
CONFIG_KEYS, CONFIG_SPLITS = ("path", "train", "val", "nc", "names"), ("train", "val", "test")


def configs(df: DataFrame, paths: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """Each configuration's path with missing (required keys that it lacks), absent (folders of its splits that aren't among the
    column of ``paths``) and valid.

    Read are the top-level keys of block YAML or of a JSON object, and plain or quoted scalars. Null or empty texts lack every
    key. Absent folders don't make a configuration invalid. Paths are unique.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    is_json = F.ltrim(whole).startswith("{")
    found = F.when(is_json, F.json_object_keys(whole)).otherwise(F.regexp_extract_all(whole, F.lit(r"(?m)^[\"']?([A-Za-z_]\w*)[\"']?\s*:"), 1))
    block = lambda k: F.regexp_extract(whole, rf"(?m)^[\"']?{k}[\"']?[ \t]*:[ \t]*[\"']?([^\"'#\n]*?)[\"']?[ \t]*(?:#.*)?$", 1)
    value = lambda k: F.when(is_json, F.get_json_object(whole, f"$.{k}")).otherwise(block(k))
    root = F.regexp_replace(value("path"), "/+$", "")
    folders = F.filter(F.array(*[F.when(F.array_contains(F.col("_keys"), k), F.concat_ws("/", root, value(k))) for k in CONFIG_SPLITS]), lambda x: x.isNotNull())
    rows = df.withColumn("_keys", F.coalesce(found, F.array().cast("array<string>"))).select(F.col(path).alias("path"), F.array_except(F.array(*map(F.lit, CONFIG_KEYS)), "_keys").alias("missing"), folders.alias("_folders"))
    asked = rows.select(F.explode("_folders").alias("_folder")).distinct()
    gone = asked.join(paths.select(F.col(paths.columns[0]).alias("_folder")), "_folder", "left_anti").withColumn("_gone", F.lit(True))
    each = rows.select("path", "missing", F.posexplode_outer("_folders").alias("_i", "_folder")).join(gone, "_folder", "left")
    out = each.groupBy("path", "missing").agg(F.array_sort(F.collect_list(F.when(F.col("_gone"), F.struct("_i", "_folder")))).alias("a"))
    return out.select("path", "missing", F.transform("a", lambda x: x["_folder"]).alias("absent"), (F.size("missing") == 0).alias("valid"))
