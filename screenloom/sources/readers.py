"""Sources: URL lists, element files, annotations, label files, prediction files and page markup."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schema import CLASSES

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
HIDDEN_TAGS = {"head", "meta", "title", "style", "script", "link", "base", "template", "noscript"}


def urls(spark: SparkSession, path: str) -> DataFrame:
    """url: the first column of a headerless CSV; blank lines and lines that begin with # are left out."""
    first = spark.read.schema("url string").csv(path, header=False, mode="PERMISSIVE", enforceSchema=True)
    return clean_urls(first)


def clean_urls(df: DataFrame) -> DataFrame:
    return df.select(strip(F.col("url")).alias("url")).where((F.col("url") != "") & ~F.startswith("url", F.lit("#")))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """path and doc (VARIANT) of each file; null for what isn't JSON."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """path and doc of each line that is JSON; blank and malformed lines are left out."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.try_parse_json("value").alias("doc"))
    return lines.where("doc IS NOT NULL")


def complete_records(files: DataFrame) -> DataFrame:
    """stem of each name in ``files`` (name) that has all of .meta.json, .png and .elements.json."""
    kind = F.regexp_extract("name", r"(\.meta\.json|\.elements\.json|\.png)$", 1)
    return files.select(kind.alias("kind"), F.regexp_replace("name", r"(\.meta\.json|\.elements\.json|\.png)$", "").alias("stem")).where("kind <> ''").groupBy("stem").agg(F.countDistinct("kind").alias("n")).where("n = 3").select("stem")


def processed_stems(files: DataFrame) -> DataFrame:
    """The URL stems of screenshot names stem-HASH.png."""
    base = F.regexp_extract("name", r"([^/]*)\.png$", 1)
    return files.select(F.regexp_extract(base, "^(.*)-[^-]*$", 1).alias("stem"), base.alias("base")).where(F.contains("base", F.lit("-"))).select("stem").distinct()


def _number(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "double")


def box_of(v: Column) -> Column:
    """x, y, w, h of an object (VARIANT): bbox as an object or a list (x, y, w, h), rect, bbox_ltrb, bbox_tlbr, bbox_xywh;
    the first that is there. Null if none is."""

    def of(*e):
        return F.struct(*[x.alias(c) for c, x in zip("xywh", e, strict=True)])

    def fields(name):
        return of(*[F.coalesce(_number(v, f"$.{name}.{c}"), F.lit(0.0)) for c in "xywh"])

    def items(name):
        return [_number(v, f"$.{name}[{k}]") for k in range(4)]

    def kind(name):
        return F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))

    def is_four(name):
        return F.startswith(kind(name), F.lit("ARRAY")) & items(name)[3].isNotNull() & _number(v, f"$.{name}[4]").isNull()

    l, t, r, b = items("bbox_ltrb")  # noqa: E741
    t2, l2, b2, r2 = items("bbox_tlbr")
    return (
        F.when(F.startswith(kind("bbox"), F.lit("OBJECT")), fields("bbox"))
        .when(is_four("bbox"), of(*items("bbox")))
        .when(F.startswith(kind("rect"), F.lit("OBJECT")), fields("rect"))
        .when(is_four("bbox_ltrb"), of(l, t, r - l, b - t))
        .when(is_four("bbox_tlbr"), of(l2, t2, r2 - l2, b2 - t2))
        .when(is_four("bbox_xywh"), of(*items("bbox_xywh")))
    )


def element_of(v: Column) -> dict[str, Column]:
    """box, label, text and score of an object; empty texts and scores of zero fall through to the next field."""
    text = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])
    score = F.coalesce(*[F.nullif(_number(v, f"$.{n}"), F.lit(0.0)) for n in ("score", "confidence")])
    return {"box": box_of(v), "label": text("label", "vlm_label", "type", "tag"), "text": text("text", "inner_text", "own_text"), "score": score}


def items_of(v: Column, names=("elements", "items", "data")) -> Column:
    """The array of objects of a document: itself, or the first list among ``names``."""
    whole = F.try_variant_get(v, "$", "array<variant>")
    return F.coalesce(whole, *[F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names], F.array().cast("array<variant>"))


def elements_of(df: DataFrame, key: str, doc: str, names=("elements", "items", "data")) -> DataFrame:
    """key, seq and box, label, text, score of every object with a box in the document."""
    rows = df.select(key, F.posexplode(items_of(F.col(doc), names)).alias("seq", "_o"))
    made = element_of(F.col("_o"))
    return rows.select(key, F.col("seq").cast("long").alias("seq"), *[c.alias(n) for n, c in made.items()]).where("box IS NOT NULL").select(key, "seq", "box.*", "label", "text", "score")


def preferred(files: DataFrame) -> DataFrame:
    """stem, name: of a stem's ground-truth files the first of .triplets.jsonl, .elements.json, .elements.unfiltered.json."""
    ends = (".triplets.jsonl", ".elements.json", ".elements.unfiltered.json")
    rank = F.coalesce(*[F.when(F.endswith("name", F.lit(e)), F.lit(k)) for k, e in enumerate(ends)])
    stem = F.regexp_replace("name", r"\.(triplets\.jsonl|elements\.unfiltered\.json|elements\.json)$", "")
    return files.select("name", stem.alias("stem"), rank.alias("rank")).where("rank IS NOT NULL").groupBy("stem").agg(F.min(F.struct("rank", "name")).alias("b")).select("stem", "b.name")


def class_names(df: DataFrame) -> DataFrame:
    """class_id, name of the non-blank lines of one text (column text) in order."""
    lines = F.filter(F.transform(F.split("text", r"\r?\n"), strip), lambda x: x != "")
    return df.select(F.posexplode(lines).alias("class_id", "name"))


def yolo_labels(files: DataFrame, width: int, height: int, names=CLASSES) -> DataFrame:
    """split, stem, line_no, label and pixel boxes of label lines with five or more values; unreadable lines are left out,
    a class that has no name is its number."""
    parts = F.split(strip(F.col("line")), r"\s+")
    rows = files.select("split", "stem", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("line_no", "line")).where(F.size(parts) >= 5)
    c, x, y, w, h = parts[0].try_cast("int"), *[parts[k].try_cast("double") for k in (1, 2, 3, 4)]
    named = F.coalesce(F.try_element_at(F.create_map(*[v for k, n in enumerate(names) for v in (F.lit(k), F.lit(n))]), c), c.cast("string"))
    out = rows.select("split", "stem", "line_no", named.alias("label"), (x * width - w * width / 2).alias("x"), (y * height - h * height / 2).alias("y"), (w * width).alias("w"), (h * height).alias("h"))
    return out.dropna(subset=["label", "x", "y", "w", "h"])


def stratified(df: DataFrame, stratum: str, most: int, n_strata: int, key: str, seed: int = 42) -> DataFrame:
    """At most max(1, most // n_strata) rows of each stratum, picked by a hash of seed and key: a sampling operator."""
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string")))
    w = Window.partitionBy(stratum).orderBy(order, key)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(1, most // max(1, n_strata))).drop("_rn")


def two_category(df: DataFrame) -> DataFrame:
    """Annotations (l, t, r, b as shares, data_type, img_w, img_h) as pixel boxes with a label."""
    label = F.when(F.col("data_type") == "text", "Text").when(F.col("data_type").isin("icon", "widget"), "Image").otherwise(F.lower("data_type"))
    return df.withColumns({"x": F.col("l") * F.col("img_w"), "y": F.col("t") * F.col("img_h"), "w": (F.col("r") - F.col("l")) * F.col("img_w"), "h": (F.col("b") - F.col("t")) * F.col("img_h"), "label": label})


class _Walk(HTMLParser):
    """Elements of a page in preorder, with parents, depth and text; unclosed elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.stack: list[int] = []

    def handle_starttag(self, tag, attrs):
        up = self.stack[-1] if self.stack else None
        held = {k: v or "" for k, v in attrs}
        hidden = tag in HIDDEN_TAGS or "hidden" in held or held.get("aria-hidden") == "true" or "display:none" in held.get("style", "").replace(" ", "") or up is not None and self.rows[up]["hidden"]
        self.rows.append({"dom_index": len(self.rows), "parent": up, "depth": len(self.stack), "tag": tag, "attrs": held, "pieces": [], "hidden": hidden})
        if tag not in VOID:
            self.stack.append(len(self.rows) - 1)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        if any(self.rows[k]["tag"] == tag for k in self.stack):
            while self.rows[self.stack.pop()]["tag"] != tag:
                pass

    def handle_data(self, data):
        if self.stack and data.strip():
            for k in self.stack:
                self.rows[k]["pieces"].append(data)


def walk(html: str | None) -> list[dict]:
    """Elements of a page: dom_index, parent, visible_parent, depth, tag, role, attrs, visible, inner_text, n_children."""
    w = _Walk()
    w.feed(html or "")
    w.close()
    out = []
    kids = [0] * len(w.rows)
    for r in w.rows:
        if r["parent"] is not None and not r["hidden"]:
            kids[r["parent"]] += 1
    for r in w.rows:
        up = r["parent"]
        while up is not None and w.rows[up]["hidden"]:
            up = w.rows[up]["parent"]
        out.append({"dom_index": r["dom_index"], "parent": r["parent"], "visible_parent": up, "depth": r["depth"], "tag": r["tag"], "role": r["attrs"].get("role"), "attrs": r["attrs"], "visible": not r["hidden"], "inner_text": " ".join(" ".join(r["pieces"]).split()), "n_children": kids[r["dom_index"]]})
    return out


DOM = "dom_index bigint, parent bigint, visible_parent bigint, depth bigint, tag string, role string, attrs map<string,string>, visible boolean, inner_text string, n_children bigint"


def dom_elements(df: DataFrame, key: str, html: str = "html") -> DataFrame:
    """A row for each element of each page. No shuffle; null and empty pages have none."""
    kind = df.schema[key].dataType.simpleString()
    names = [key, "dom_index", "parent", "visible_parent", "depth", "tag", "role", "attrs", "visible", "inner_text", "n_children"]

    def run(batches):
        for pdf in batches:
            for k, page in zip(pdf[key], pdf[html], strict=True):
                rows = [{key: k, **r} for r in walk(page)]
                yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in names})

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, {DOM}")


def frames_united(df: DataFrame, screen: str, frame: str, index: str, parent: str) -> DataFrame:
    """Elements of all frames of a screen with indices shifted by the number of elements in the frames before."""
    sizes = df.groupBy(screen, frame).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(screen).orderBy(frame).rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.withColumn("_shift", F.coalesce(F.sum("_n").over(w), F.lit(0))).drop("_n")
    out = df.join(shifts, [screen, frame])
    return out.withColumn(index, F.col(index) + F.col("_shift")).withColumn(parent, F.col(parent) + F.col("_shift")).drop("_shift")


def is_blank(pixels: Column, white: float = 0.99) -> Column:
    """Whether over ``white`` of the grey values are above 250, or they hardly differ; null and empty images are blank."""
    n = F.size(pixels)
    bright = F.size(F.filter(pixels, lambda p: p > 250))
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, p: a + p) / n
    spread = F.aggregate(F.transform(pixels, lambda p: (p - mean) * (p - mean)), F.lit(0.0), lambda a, p: a + p) / n
    return F.coalesce((n <= 0) | (bright > white * n) | (F.sqrt(spread) < 5), F.lit(True))


def images(df: DataFrame, extensions=(".png", ".jpg", ".jpeg"), most: int | None = None) -> DataFrame:
    """name and its place of the image files in ``df`` (name): by extension in the given order, then by name; ``most`` of
    them at most, which is a sampling limit and counts images before any other test."""
    rank = F.coalesce(*[F.when(F.endswith(F.lower("name"), F.lit(e)), F.lit(k)) for k, e in enumerate(extensions)])
    found = df.select("name", rank.alias("rank")).where("rank IS NOT NULL")
    return found.orderBy("rank", "name").limit(most) if most is not None else found


def png_size(content: Column) -> dict[str, Column]:
    """Width and height from the header of a PNG's bytes; null for anything else."""
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    ok = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    return {"width": F.when(ok, number(17)), "height": F.when(ok, number(21))}


def class_config(text: str) -> list[str]:
    """Class names of a list file, of a JSON or YAML list, or of an object with ``categories`` (by id, those with a name) or ``classes``.

    Text that is neither JSON nor looks like YAML (``classes:`` or a first line that begins with ``- ``) is a list of lines.
    """
    import json
    import re

    try:
        got = json.loads(text)
    except ValueError:
        if not re.search(r"(?m)\A(?:\s*(?:#.*)?\n)*- |^classes\s*:", text):
            return [x.strip() for x in text.splitlines() if x.strip()]
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("class files in YAML need PyYAML") from e
        got = yaml.safe_load(text)
    if isinstance(got, dict) and "categories" in got:
        return [str(c["name"]) for c in sorted(got["categories"], key=lambda c: c.get("id", 0)) if "name" in c]
    return list(map(str, got["classes"] if isinstance(got, dict) else got))
