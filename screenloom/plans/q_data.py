"""Queries on sources, sinks, markup, duplicates, labels, export, validation and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import markup as M
from ..functions.geometry import Box, iou
from ..operators import dedupe, export, hierarchy, metrics, model_io, suppression, validate
from ..schema import ATOMIC, CLASSES, CONTAINERS, EIGHT_OF, NON_NESTABLE, QUALITY, TWO_TEXT, VIEWPORT_H, VIEWPORT_W
from ..sources import readers, sinks
from .fixtures import BOXES_SQL, ELEMENTS_SQL, EVAL_SQL, INTER_SQL, KEYS, _quoted, boxes, elements, pick, predictions, sql_pick, table, truth

QUERIES: dict = {}
SQL: dict[str, str] = {}
_W, _H = VIEWPORT_W, VIEWPORT_H


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


# Sources


@query("src01_url_list", "SELECT url FROM pages WHERE page_id % 10 > 1")
def src01(spark, d):
    p = table(spark, d, "pages")
    listed = F.when(F.col("page_id") % 10 == 0, F.concat(F.lit("# "), "url")).when(F.col("page_id") % 10 == 1, "  ").otherwise(F.concat(F.lit(" "), "url", F.lit(" ")))
    return readers.clean_urls(p.select(listed.alias("url")))


_BROKEN = "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN substr(props, 1, length(props) - 1) WHEN 2 THEN '' ELSE '[' || props || ']' END"


def _answers(spark, d):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("props")).when(k == 1, F.expr("left(props, length(props) - 1)")).when(k == 2, "").otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    return table(spark, d, "events").select("event_id", text.alias("text"))


@query("src03_tolerant_json", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events")
def src03(spark, d):
    return _answers(spark, d).select("event_id", F.try_variant_get(F.try_parse_json("text"), "$.k", "bigint").alias("k"))


@query("src09_json_lines", "SELECT event_id FROM events WHERE event_id % 4 IN (0, 3)")
def src09(spark, d):
    return _answers(spark, d).where(F.try_parse_json("text").isNotNull()).select("event_id")


def _names(spark, d, *ends):
    p = table(spark, d, "pages").select("page_id")
    return p.select("page_id", F.explode(F.array(*[F.struct(F.lit(e).alias("e"), F.lit(k).alias("k")) for k, e in enumerate(ends)])).alias("x")).select("page_id", F.col("x.e").alias("e"), F.col("x.k").alias("k"))


@query("src04_complete_records", "SELECT 'p' || page_id AS stem FROM pages WHERE page_id % 5 <> 0 AND page_id % 7 <> 0")
def src04(spark, d):
    n = _names(spark, d, ".meta.json", ".png", ".elements.json").where("NOT (k = 1 AND page_id % 5 = 0) AND NOT (k = 2 AND page_id % 7 = 0)")
    return readers.complete_records(n.select(F.concat(F.lit("p"), "page_id", "e").alias("name")))


@query("src06_processed_stems", "SELECT 'site-' || (page_id % 40) AS stem FROM pages GROUP BY 1")
def src06(spark, d):
    return readers.processed_stems(table(spark, d, "pages").select(F.concat(F.lit("out/site-"), F.col("page_id") % 40, F.lit("-"), F.substring(F.sha2("url", 256), 1, 16), F.lit(".png")).alias("name")))


@query("src12_preferred_truth", "SELECT 'p' || page_id AS stem, 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.triplets.jsonl' WHEN 1 THEN '.elements.json' ELSE '.elements.unfiltered.json' END AS name FROM pages")
def src12(spark, d):
    n = _names(spark, d, ".triplets.jsonl", ".elements.json", ".elements.unfiltered.json", ".png").where("k >= page_id % 3")
    return readers.preferred(n.select(F.concat(F.lit("p"), "page_id", "e").alias("name")))


def _objects(spark, d) -> DataFrame:
    """A JSON object a box, with its box in one of seven ways."""
    b = boxes(spark, d)
    x, y, w, h = (F.col(c) for c in "xywh")
    four = lambda *v: F.concat(F.lit("["), F.concat_ws(",", *[c.cast("string") for c in v]), F.lit("]"))
    obj = lambda: F.concat(F.lit('{"x":'), x, F.lit(',"y":'), y, F.lit(',"w":'), w, F.lit(',"h":'), h, F.lit("}"))
    kind = F.col("part") % 7
    box = (
        F.when(kind == 0, F.concat(F.lit('"bbox":'), obj())).when(kind == 1, F.concat(F.lit('"bbox":'), four(x, y, w, h))).when(kind == 2, F.concat(F.lit('"rect":'), obj()))
        .when(kind == 3, F.concat(F.lit('"bbox_ltrb":'), four(x, y, x + w, y + h))).when(kind == 4, F.concat(F.lit('"bbox_tlbr":'), four(y, x, y + h, x + w)))
        .when(kind == 5, F.concat(F.lit('"bbox_xywh":'), four(x, y, w, h))).otherwise(F.lit('"other":1'))
    )
    rest = F.concat(F.lit(',"label":"'), F.when(F.col("supp") % 2 == 0, "").otherwise("Button"), F.lit('","type":"link","score":'), F.col("supp") % 3, F.lit(',"confidence":0.5,"inner_text":"t'), F.col("supp") % 10, F.lit('"'))
    return b.select("screen", "seq", "part", F.concat(F.lit("{"), box, rest, F.lit("}")).alias("json"))


@query("src07_boxes_of_objects", f"{BOXES_SQL} SELECT screen, seq, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y, CAST(w AS DOUBLE) AS w, CAST(h AS DOUBLE) AS h FROM boxes WHERE part % 7 <> 6")
def src07(spark, d):
    return _objects(spark, d).select("screen", "seq", readers.box_of(F.parse_json("json")).alias("b")).where("b IS NOT NULL").select("screen", "seq", "b.*")


@query("src08_elements_of_objects", f"{BOXES_SQL} SELECT screen, seq, CASE WHEN supp % 2 = 0 THEN 'link' ELSE 'Button' END AS label, 't' || (supp % 10) AS text, CASE supp % 3 WHEN 0 THEN 0.5 ELSE CAST(supp % 3 AS DOUBLE) END AS score FROM boxes WHERE part % 7 <> 6")
def src08(spark, d):
    made = readers.element_of(F.parse_json("json"))
    return _objects(spark, d).select("screen", "seq", *[c.alias(n) for n, c in made.items()]).where("box IS NOT NULL").drop("box")


def _documents(spark, d, name):
    """One document a screen: a list, or an object with the list under ``name``."""
    lists = _objects(spark, d).groupBy("screen").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "json"))), lambda v: v["json"]), ",").alias("l"))
    body = F.concat(F.lit("["), "l", F.lit("]"))
    return lists.select("screen", F.parse_json(F.when(F.col("screen") % 2 == 0, body).otherwise(F.concat(F.lit('{"n":1,"' + name + '":'), body, F.lit("}")))).alias("doc"))


_DOC_SQL = f"{BOXES_SQL} SELECT screen, seq, CAST(x AS DOUBLE) AS x, CAST(h AS DOUBLE) AS h FROM boxes WHERE part % 7 <> 6"


@query("src10_element_files", _DOC_SQL)
def src10(spark, d):
    return readers.elements_of(_documents(spark, d, "elements"), "screen", "doc").select("screen", "seq", "x", "h")


@query("src11_annotation_files", _DOC_SQL)
def src11(spark, d):
    return readers.elements_of(_documents(spark, d, "annotations"), "screen", "doc", ("items", "data", "annotations")).select("screen", "seq", "x", "h")


@query("src13_images", "SELECT name FROM (SELECT 'p' || page_id || CASE page_id % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.PNG' ELSE '.txt' END AS name, page_id % 3 AS k FROM pages) WHERE k < 2 ORDER BY k = 0, name LIMIT 20")
def src13(spark, d):
    end = F.when(F.col("page_id") % 3 == 0, ".jpg").when(F.col("page_id") % 3 == 1, ".PNG").otherwise(".txt")
    return readers.images(table(spark, d, "pages").select(F.concat(F.lit("p"), "page_id", end).alias("name")), most=20).select("name")


@query("src22_image_size", "SELECT page_id, CASE WHEN page_id % 4 <> 0 THEN CAST(1000 + page_id AS INTEGER) END AS width, CASE WHEN page_id % 4 <> 0 THEN 900 END AS height FROM pages")
def src22(spark, d):
    four = lambda c: F.lpad(F.hex(c), 8, "0")
    head = F.when(F.col("page_id") % 4 == 0, "00").otherwise("89504E470D0A1A0A")
    png = F.unhex(F.concat(head, F.lit("0000000D49484452"), four(F.col("page_id") + 1000), four(F.lit(900))))
    made = readers.png_size(png)
    return table(spark, d, "pages").select("page_id", made["width"].alias("width"), made["height"].alias("height"))


@query("src14_dataset_join", "SELECT page_id, 'p' || page_id || '.elements.json' AS truth FROM pages WHERE page_id % 4 <> 0")
def src14(spark, d):
    p = table(spark, d, "pages").select("page_id", F.concat(F.lit("p"), "page_id").alias("stem"))
    files = readers.preferred(p.where("page_id % 4 <> 0").select(F.concat("stem", F.lit(".elements.json")).alias("name")))
    return p.join(files, "stem").select("page_id", F.col("name").alias("truth"))


@query("src15_stratified", "SELECT page_id, platform FROM (SELECT page_id, page_id % 5 AS platform, row_number() OVER (PARTITION BY page_id % 5 ORDER BY md5('42/' || page_id), page_id) AS rn FROM pages) WHERE rn <= 10")
def src15(spark, d):
    return readers.stratified(table(spark, d, "pages").select("page_id", (F.col("page_id") % 5).alias("platform")), "platform", 50, 5, "page_id")


@query("src16_two_category", f"{BOXES_SQL} SELECT screen, seq, round(x / 4000.0 * 1440, 6) AS x, round(w / 4000.0 * 1440, 6) AS w, CASE part % 3 WHEN 0 THEN 'Text' WHEN 1 THEN 'Image' ELSE 'other' END AS label FROM boxes")
def src16(spark, d):
    b = boxes(spark, d)
    rel = b.select("screen", "seq", (F.col("x") / 4000).alias("l"), (F.col("y") / 4000).alias("t"), ((F.col("x") + F.col("w")) / 4000).alias("r"), ((F.col("y") + F.col("h")) / 4000).alias("b"), pick(("text", "icon", "Other"), F.col("part")).alias("data_type"), F.lit(_W).alias("img_w"), F.lit(_H).alias("img_h"))
    return readers.two_category(rel).select("screen", "seq", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"), "label")


@query("src17_class_names", f"SELECT CAST(class_id AS INTEGER) AS class_id, name FROM (SELECT unnest([{_quoted(CLASSES)}]) AS name, unnest(range({len(CLASSES)})) AS class_id)")
def src17(spark, d):
    text = "\n\n".join(f" {c} " for c in CLASSES)
    return readers.class_names(spark.createDataFrame([(text,)], "text string")).select("class_id", "name")


def _label_files(spark, d) -> DataFrame:
    """A label file an order, some with errors; one in ten has none."""
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("split"), F.col("o_orderkey").alias("stem"))
    k = F.col("stem") % 10
    good = F.format_string("%d 0.500000 0.250000 0.100000 0.200000", (F.col("stem") % 55).cast("int"))
    bad = F.when(k == 1, F.lit("\n1 0.5 0.5 0.1")).when(k == 2, F.lit("\n55 0.5 0.5 0.1 0.1")).when(k == 3, F.lit("\n3 1.5 0.5 0.1 0.1")).when(k == 4, F.lit("\nx 0.5 0.5 0.1 0.1")).when(k == 5, F.lit("\n3 0.5 0.5 0 0.1 ")).otherwise(F.lit(""))
    return o.withColumn("text", F.when(k == 6, F.lit("")).otherwise(F.concat(good, bad)))


@query("src18_label_lines", f"""SELECT o_orderkey AS stem, {sql_pick(CLASSES, 'o_orderkey % 55')} AS label, 648.0::DOUBLE AS x FROM orders WHERE o_orderkey % 10 <> 6
UNION ALL SELECT o_orderkey, CASE o_orderkey % 10 WHEN 2 THEN '55' ELSE 'Utility Button' END, CASE o_orderkey % 10 WHEN 2 THEN 648.0 WHEN 3 THEN 2088.0 ELSE 720.0 END FROM orders WHERE o_orderkey % 10 IN (2, 3, 5)""")
def src18(spark, d):
    return readers.yolo_labels(_label_files(spark, d), _W, _H).select("stem", "label", F.round("x", 6).alias("x"))


@query("src19_label_dataset", "SELECT o_orderkey % 3 AS split, count(*) AS n FROM orders WHERE o_orderkey % 10 <> 7 AND o_orderkey % 4 <> 0 GROUP BY 1")
def src19(spark, d):
    files = _label_files(spark, d).where("stem % 10 <> 7")
    images = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("split"), F.col("o_orderkey").alias("stem"), F.when(F.col("o_orderkey") % 4 != 0, F.lit(_W)).alias("img_w")).where("img_w IS NOT NULL")
    return images.join(files, ["split", "stem"]).groupBy("split").agg(F.count("*").alias("n"))


@query("src20_offline_predictions", f"{EVAL_SQL} SELECT g.screen, count(p.seq) AS n FROM (SELECT DISTINCT screen FROM gt) g LEFT JOIN (SELECT * FROM pred WHERE screen % 4 <> 0) p ON p.screen = g.screen GROUP BY g.screen")
def src20(spark, d):
    stored = predictions(spark, d).where("screen % 4 <> 0").groupBy("screen").agg(F.count("*").alias("n"))
    return truth(spark, d).select("screen").distinct().join(stored, "screen", "left").select("screen", F.coalesce("n", F.lit(0)).alias("n"))


# Sinks


@query("snk02_triplets", f"{ELEMENTS_SQL} SELECT screen, seq AS element_index, x || ',' || y || ',' || (x + w) || ',' || (y + h) AS bbox, type, CASE part % 3 WHEN 0 THEN 'ocr ' || seq WHEN 1 THEN '' ELSE inner_text END AS text, tag, role FROM elements")
def snk02(spark, d):
    el = elements(spark, d).withColumn("inner_text", F.when(F.col("part") % 3 < 2, " ").otherwise(F.col("inner_text")))
    ocr = el.where("part % 3 = 0").select("screen", "seq", F.concat(F.lit(" ocr "), "seq").alias("text"))
    return sinks.triplets(el, ocr, KEYS).select("screen", "element_index", F.array_join(F.col("bbox_ltrb").cast("array<string>"), ",").alias("bbox"), "type", "text", "tag", "role")


def _label_rows(spark, d, clean=False, ratios=(0.7, 0.2, 0.1)):
    return export.labels(elements(spark, d), "screen", _W, _H, ratios, clean=clean)




def _class_sql() -> str:
    from ..schema import TYPE_KEYWORDS

    exact = " ".join(f"WHEN type = '{c.lower()}' THEN '{c}'" for c in CLASSES)
    words = " ".join(f"WHEN contains(type, '{k}') THEN '{c}'" for k, c in TYPE_KEYWORDS)
    return f"CASE WHEN coalesce(label, 'unknown') <> 'unknown' THEN label {exact} {words} ELSE 'Text' END"


_R = f"('0x' || substr(md5('42/' || screen), 1, 15))::BIGINT / {16**15}.0::DOUBLE"
LABELS_SQL = f"""{ELEMENTS_SQL}, labels AS (SELECT screen, seq, CASE WHEN {_R} < 0.7 THEN 'train' WHEN {_R} < 0.7 + 0.2 THEN 'val' ELSE 'test' END AS split, {_class_sql()} AS class_name,
least(1, (x + w / 2.0) / {_W}) AS cx, least(1, (y + h / 2.0) / {_H}) AS cy, least(1, w::DOUBLE / {_W}) AS bw, least(1, h::DOUBLE / {_H}) AS bh FROM elements)"""


@query("snk05_label_text", f"{LABELS_SQL} SELECT screen, count(*) AS n_lines FROM labels GROUP BY screen")
def snk05(spark, d):
    files = export.label_files(_label_rows(spark, d), "screen")
    return files.select("screen", F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("snk06_class_list", f"SELECT '{chr(10).join(CLASSES)}' AS text")
def snk06(spark, d):
    return spark.createDataFrame([(export.class_list(),)], "text string")


@query("snk07_class_stats", f"{LABELS_SQL} SELECT split, class_name, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (PARTITION BY split), 4) AS share_pct FROM labels GROUP BY split, class_name")
def snk07(spark, d):
    return export.class_stats(_label_rows(spark, d))


@query("snk08_groups_csv", "SELECT p_partkey // 8 * 8 AS group_id, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
def snk08(spark, d):
    return dedupe.duplicate_groups(_hashes(spark, d), "p_partkey").groupBy("group_id").agg(F.count("*").alias("n"))


@query("snk09_relabelled", f"{ELEMENTS_SQL} SELECT screen, seq, CASE WHEN part % 3 = 0 THEN 'Button' END AS vlm_label, CASE WHEN part % 3 = 0 THEN part % 2 = 0 END AS interactable FROM elements")
def snk09(spark, d):
    el = elements(spark, d)
    answers = el.where("part % 3 = 0").select("screen", "seq", F.lit("Button").alias("label"), (F.col("part") % 2 == 0).alias("interactable"))
    return model_io.relabel(el, answers, ["screen", "seq"]).select("screen", "seq", "vlm_label", F.col("vlm_interactable").alias("interactable"))


@query("snk10_rejected", "SELECT doc_id FROM labels WHERE quality * 80 + 15 - 20 * toxic < 70")
def snk10(spark, d):
    return model_io.quality_scores(_quality_answers(spark, d), "doc_id", "answer").where("NOT accepted").select("doc_id")


def _long(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("metric")).agg((F.sum(F.rint(F.col("value") * 100).cast("long")) / F.count("*") / 1000).alias("value"))


@query("snk12_summary", "WITH s AS (SELECT 'm' || (user_id % 3) AS model, event_type AS metric, sum(CAST(round_even(value * 100, 0) AS BIGINT)) / count(*) / 1000 AS value FROM events GROUP BY ALL) SELECT model, " + ", ".join(f"coalesce(max(CASE WHEN metric = '{m}' THEN printf('%.3f', value) END), '') AS \"{m}\"" for m in ("click", "error", "purchase", "signup", "view")) + " FROM s GROUP BY model")
def snk12(spark, d):
    return metrics.summary(_long(spark, d))


@query("snk13_prediction_json", f"{EVAL_SQL} SELECT screen, count(*) AS n FROM pred GROUP BY screen")
def snk13(spark, d):
    j = sinks.prediction_json(predictions(spark, d), KEYS)
    return j.select("screen", F.size(F.from_json("elements", "array<struct<label:string>>")).cast("long").alias("n"))


_SLUG_SQL = "coalesce(nullif(trim(regexp_replace(lower({0}), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown')[1:{1}]"


@query("snk15_run_ids", f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'm0-model' WHEN o_orderkey % 3 = 1 THEN 'm2-' || {_SLUG_SQL.format("o_orderstatus || '_v2'", 20)} || '+' || {_SLUG_SQL.format("o_orderpriority", 20)} ELSE 'm7-a+a+a+a+a+2' END
|| '_n' || o_custkey || '_ds-' || CASE WHEN o_orderkey % 4 = 0 THEN 'ss-web' WHEN o_orderkey % 4 = 1 THEN 'ss' ELSE 'ss-' || {_SLUG_SQL.format("o_custkey || ' (' || o_orderpriority || ')'", 16)} END || '_map-c55' AS run_id FROM orders""")
def snk15(spark, d):
    k = F.col("o_orderkey")
    models = F.when(k % 3 == 0, F.array().cast("array<string>")).when(k % 3 == 1, F.array(F.concat("o_orderstatus", F.lit("_v2")), "o_orderpriority")).otherwise(F.array(*[F.lit("A!")] * 7))
    root = F.when(k % 4 == 1, F.lit("/data/My-WebSet/")).otherwise(F.concat(F.lit("/x/"), F.col("o_custkey"), F.lit(" ("), "o_orderpriority", F.lit(")")))
    data = sinks.dataset_token(root, "ss", "webset", F.when(k % 4 == 0, F.lit("Web")).otherwise("all"))
    return table(spark, d, "orders").select("o_orderkey", sinks.run_id(models, F.col("o_custkey"), data, F.lit("c55")).alias("run_id"))


@query("snk14_inference_rows", f"{ELEMENTS_SQL} SELECT screen, seq, type, CASE WHEN part % 2 = 0 THEN 'own' ELSE inner_text END AS text FROM elements")
def snk14(spark, d):
    own = F.when(F.col("part") % 2 == 0, "own").otherwise("")
    return elements(spark, d).select("screen", "seq", "type", F.coalesce(F.nullif(own, F.lit("")), "inner_text").alias("text"))


# Markup


@query("tag01_tokens", f"{ELEMENTS_SQL} SELECT screen, seq, '<loc_' || CAST(round_even(least(1.0, greatest(0.0, x::DOUBLE / {_W})) * 500, 0) AS BIGINT) || '>' AS token FROM elements")
def tag01(spark, d):
    return elements(spark, d).select("screen", "seq", M.token(F.col("x") / _W).alias("token"))


def _loc(v, size):
    return f"'<loc_' || CAST(round_even(least(1.0, greatest(0.0, ({v})::DOUBLE / {size})) * 500, 0) AS BIGINT) || '>'"


_LOC4 = " || ".join([_loc("x", _W), _loc("y", _H), _loc("x + w", _W), _loc("y + h", _H)])


@query("tag02_locations", f"{ELEMENTS_SQL} SELECT screen, seq, {_LOC4} AS location FROM elements")
def tag02(spark, d):
    x, y, w, h = (F.col(c) for c in "xywh")
    return elements(spark, d).select("screen", "seq", M.location(x + w, y, x, y + h, _W, _H).alias("location"))


_TAG = "trim(regexp_replace(regexp_replace(klass, '[^a-zA-Z0-9_-]', '_', 'g'), '_+', '_', 'g'), '_')"


@query("tag03_tag_names", f"{ELEMENTS_SQL} SELECT screen, seq, {_TAG} AS name FROM elements")
def tag03(spark, d):
    return elements(spark, d).select("screen", "seq", M.tag_name(F.col("label"), F.col("type"), F.col("tag")).alias("name"))


def _markup(spark, d):
    return hierarchy.serialize(elements(spark, d).withColumn("text", F.col("inner_text")), KEYS)


@query("tag04_serialize", f"{ELEMENTS_SQL} SELECT screen, CAST(23 + sum(2 * length({_TAG}) + 5 + length({_LOC4}) + length(inner_text)) AS BIGINT) AS n_chars FROM elements GROUP BY screen")
def tag04(spark, d):
    return _markup(spark, d).select("screen", F.length("markup").cast("long").alias("n_chars"))


@query("tag05_parse", f"{ELEMENTS_SQL} SELECT screen, CAST(length(bin(seq + 1)) - 1 AS INTEGER) AS depth, {_TAG} AS tag, '<loc_' || concat_ws('><loc_', {', '.join(f'CAST(round_even(least(1.0, ({v})::DOUBLE / {s}) * 500, 0) AS BIGINT)' for v, s in (('x', _W), ('y', _H), ('x + w', _W), ('y + h', _H)))}) || '>' AS location, inner_text AS text FROM elements")
def tag05(spark, d):
    nodes = hierarchy.parse(_markup(spark, d), "screen")
    return nodes.select("screen", "depth", "tag", F.concat(F.lit("<loc_"), F.concat_ws("><loc_", *[F.col(c).cast("string") for c in "ltrb"]), F.lit(">")).alias("location"), "text")


@query("tag06_parse_strict", f"{ELEMENTS_SQL} SELECT screen, CAST(length(bin(seq + 1)) - 1 AS INTEGER) AS depth, {_TAG} AS tag, CAST(trunc(round_even(least(1.0, x::DOUBLE / {_W}) * 500, 0) / 500 * {_W}) AS INTEGER) AS l, inner_text AS text FROM elements")
def tag06(spark, d):
    return hierarchy.parse(_markup(spark, d), "screen", strict=True, width=_W, height=_H).select("screen", "depth", "tag", "l", "text")


@query("tag07_stats", f"{ELEMENTS_SQL} SELECT screen, count(*) AS total, max(length(bin(seq + 1))) AS max_depth FROM elements GROUP BY screen")
def tag07(spark, d):
    return hierarchy.parse(_markup(spark, d), "screen").groupBy("screen").agg(F.count("*").alias("total"), (F.max("depth") + 1).cast("long").alias("max_depth"))


@query("tag08_top_types", f"{ELEMENTS_SQL} SELECT {_TAG} AS tag, count(*) AS n FROM elements GROUP BY 1 ORDER BY n DESC, tag LIMIT 15")
def tag08(spark, d):
    return hierarchy.parse(_markup(spark, d), "screen").groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(15)


@query("tag09_tree_text", f"{ELEMENTS_SQL} SELECT screen, count(*) + 1 AS n_lines FROM elements GROUP BY screen")
def tag09(spark, d):
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("string")
    def tree(m):
        return m.map(lambda s: M.tree_text(M.read(s)))

    return _markup(spark, d).select("screen", F.size(F.split(tree("markup"), "\n")).cast("long").alias("n_lines"))


@query("tag11_denormalized", f"{ELEMENTS_SQL} SELECT screen, seq, round(least(500.0, x) / 500 * {_W}, 6) AS x FROM elements")
def tag11(spark, d):
    return elements(spark, d).select("screen", "seq", F.round(M.denormalized(F.col("x"), _W), 6).alias("x"))


@query("tag12_flattened", f"{ELEMENTS_SQL} SELECT screen, count(*) AS n FROM elements GROUP BY screen")
def tag12(spark, d):
    """Nodes as elements, in preorder; the rank is explicit."""
    nodes = hierarchy.parse(_markup(spark, d), "screen")
    return nodes.select("screen", F.col("node_id").alias("rank"), "tag", "text").groupBy("screen").agg(F.count("*").alias("n"))


@query("tag13_by_pattern", f"{ELEMENTS_SQL} SELECT screen, count(*) AS n FROM elements GROUP BY screen")
def tag13(spark, d):
    """What a pattern alone finds in markup that has no end tags."""
    m = _markup(spark, d).withColumn("m", F.regexp_replace("markup", "</[^>]*>", ""))
    return m.select("screen", F.size(F.regexp_extract_all("m", F.lit(r"<([a-zA-Z0-9_-]+)>(?:\s*<loc_\d+>){4}"), 1)).cast("long").alias("n"))


@query("tag14_screens_to_markup")
def tag14(spark, d):
    from ..operators import filters

    el = elements(spark, d)
    kept = filters.filter_elements(el, KEYS).withColumnRenamed("parent", "up")
    joined = el.join(kept, [*KEYS, "seq"]).withColumn("parent", F.col("up"))
    own = hierarchy.own_texts(joined, KEYS, ("parent", *"xywh", "label", "type", "tag"))
    return hierarchy.serialize(own.withColumn("text", F.col("own_text")), KEYS)


# Duplicates


def _hashes(spark, d) -> DataFrame:
    """A 60-bit hash a part: those of eight neighbours differ by up to four bits, others at random."""
    base = F.conv(F.substring(F.md5(F.floor(F.col("p_partkey") / 8).cast("string")), 1, 15), 16, 10).cast("long")
    flip = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))
    k = F.col("p_partkey") % 8
    return table(spark, d, "part").select("p_partkey", base.bitwiseXOR(flip(k * 7)).bitwiseXOR(flip(k * 3 + 1)).alias("hash"))


_HASHES_SQL = "WITH h AS (SELECT p_partkey, xor(xor(('0x' || substr(md5(CAST(p_partkey // 8 AS VARCHAR)), 1, 15))::BIGINT, 1::BIGINT << (p_partkey % 8 * 7)::INTEGER), 1::BIGINT << (p_partkey % 8 * 3 + 1)::INTEGER) AS hash FROM part)"


@query("dup01_phash")
def dup01(spark, d):
    return dedupe.perceptual_hashes(table(spark, d, "embeddings"), "vec_id", "embedding")


@query("dup02_hamming", f"{_HASHES_SQL} SELECT p_partkey, CAST(bit_count(xor(hash, 1234567890123456789)) AS BIGINT) AS distance FROM h")
def dup02(spark, d):
    return _hashes(spark, d).select("p_partkey", dedupe.hamming(F.col("hash"), F.lit(1234567890123456789)).cast("long").alias("distance"))


@query("dup03_within_radius", f"{_HASHES_SQL} SELECT a.hash AS hash_a, b.hash AS hash_b, CAST(bit_count(xor(a.hash, b.hash)) AS BIGINT) AS distance FROM h a JOIN h b ON a.hash < b.hash AND bit_count(xor(a.hash, b.hash)) <= 8")
def dup03(spark, d):
    return dedupe.within_radius(_hashes(spark, d), "p_partkey").withColumn("distance", F.col("distance").cast("long"))


@query("dup04_groups", "SELECT p_partkey, p_partkey // 8 * 8 AS group_id FROM part")
def dup04(spark, d):
    return dedupe.duplicate_groups(_hashes(spark, d), "p_partkey")


@query("dup05_keep_first", "SELECT p_partkey FROM part WHERE p_partkey % 8 = 0")
def dup05(spark, d):
    return dedupe.keep_first(_hashes(spark, d), "p_partkey").select("p_partkey")


# Suppression


def _edges(spark, d, scored=False):
    b = boxes(spark, d)
    cls = pick(CLASSES, F.col("cls"))
    x, y, w, h = (F.col(c) for c in "xywh")
    return b.select("screen", "seq", "cls", *"xywh", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), cls.isin(*CONTAINERS).alias("container"), cls.isin(*ATOMIC).alias("atomic"), cls.isin(*NON_NESTABLE).alias("non_nestable"), (((F.col("part") * 31 + F.col("supp") * 17) % 1000) / 1000.0).alias("score"))


@query("nms01_clean_boxes")
def nms01(spark, d):
    return suppression.clean_boxes(_edges(spark, d), KEYS)


@query("nms02_fuse")
def nms02(spark, d):
    return suppression.fuse(_edges(spark, d), KEYS)


@query("nms03_fused_box", f"{BOXES_SQL}, s AS (SELECT screen, cls, x, ((part * 31 + supp * 17) % 1000) / 1000.0::DOUBLE AS score FROM boxes) SELECT screen, cls, round(sum(x * score) / (sum(score) + 0.000001), 4) AS x1 FROM s GROUP BY screen, cls")
def nms03(spark, d):
    e = _edges(spark, d)
    return e.groupBy("screen", "cls").agg(F.round(F.sum(F.col("x1") * F.col("score")) / (F.sum("score") + suppression.EPSILON), 4).alias("x1"))


@query("nms04_drop_wrappers")
def nms04(spark, d):
    return suppression.drop_wrappers(_edges(spark, d), KEYS)


_FLAGS_SQL = f"""{BOXES_SQL}, f AS (SELECT *, {sql_pick(CLASSES, 'cls')} AS name, ((part * 31 + supp * 17) % 1000) / 1000.0::DOUBLE AS score FROM boxes),
g AS (SELECT *, name IN ({_quoted(CONTAINERS)}) AS container FROM f),
l AS (SELECT b.screen, b.seq AS parent, a.seq AS child FROM g a JOIN g b ON a.screen = b.screen AND a.seq <> b.seq AND b.container AND 100 * {INTER_SQL} >= 75 * a.w * a.h)"""


@query("nms05_reweighted", f"""{_FLAGS_SQL} SELECT g.screen, g.seq, round(score * CASE WHEN container AND k.n > 0 THEN 1 + least(0.5, 0.1 * k.n) ELSE 1 END * CASE WHEN NOT container AND u.n > 0 THEN 1.1 ELSE 1 END, 6) AS score
FROM g LEFT JOIN (SELECT screen, parent, count(*) AS n FROM l GROUP BY ALL) k ON k.screen = g.screen AND k.parent = g.seq LEFT JOIN (SELECT screen, child, count(*) AS n FROM l GROUP BY ALL) u ON u.screen = g.screen AND u.child = g.seq""")
def nms05(spark, d):
    return suppression.reweighted(_edges(spark, d), KEYS).select("screen", "seq", F.round("score", 6).alias("score"))


@query("nms06_postprocess")
def nms06(spark, d):
    return suppression.postprocess(_edges(spark, d), KEYS)


@query("nms07_class_sets", f"SELECT name, name IN ({_quoted(CONTAINERS)}) AS container, name IN ({_quoted(ATOMIC)}) AS atomic, name IN ({_quoted(NON_NESTABLE)}) AS non_nestable FROM (SELECT unnest([{_quoted(CLASSES)}]) AS name)")
def nms07(spark, d):
    c = spark.createDataFrame([(x,) for x in CLASSES], "name string")
    return c.select("name", *[F.lower("name").isin(*[x.lower() for x in xs]).alias(n) for n, xs in (("container", CONTAINERS), ("atomic", ATOMIC), ("non_nestable", NON_NESTABLE))])


@query("nms08_iou_same_class", f"{BOXES_SQL}, p AS (SELECT a.screen, a.seq AS a_seq, b.seq AS b_seq, {INTER_SQL} AS inter, a.w * a.h + b.w * b.h AS s FROM boxes a JOIN boxes b ON a.screen = b.screen AND a.cls = b.cls AND a.seq < b.seq) SELECT screen, a_seq, b_seq, round(inter / (s - inter), 6) AS iou FROM p WHERE inter > 0")
def nms08(spark, d):
    b = boxes(spark, d).select("screen", "cls", "seq", *"xywh")
    return metrics.overlapping(b, b, ["screen", "cls"]).where("a_seq < b_seq").select("screen", "a_seq", "b_seq", F.round(iou(Box.of("a_"), Box.of("b_")), 6).alias("iou"))


# Labels and model answers

_RAW = ("navbar", " Button ", "search box", "PROGRESS-BAR", "icon", "Logo_Image", "-", "Utility_Button", "list item", "zzz", "tabs", "check/box", "")
_EXPECTED = ("Navigation Bar", "Button", "Search Field", "Progress bar", "File Icon", "Logo", "Table", "Button", "List Item", None, "Tab", "Checkbox", None)


@query("lbl04_normalized", f"SELECT p_partkey, {sql_pick(_EXPECTED, 'p_partkey')} AS label FROM part")
def lbl04(spark, d):
    return table(spark, d, "part").select("p_partkey", L.normalize_label(pick(_RAW, F.col("p_partkey"))).alias("label"))


@query("lbl01_matched", f"SELECT p_partkey, {sql_pick((None, 'Button', None, None, None, None, None, None, 'List Item', None, None, None, None), 'p_partkey')} AS label FROM part")
def lbl01(spark, d):
    return table(spark, d, "part").select("p_partkey", L.match_label(pick(_RAW, F.col("p_partkey"))).alias("label"))


_TYPES = ("btn", "input field", "research", "radio", "sortable", "playlist", "submenu", "canvas", "figure img", "Date-Time Picker", "unknown", "", "chip", "card")
_TYPE_CLASS = ("Button", "Text Input", "Search Field", "Radiobox", "Table", "List", "Menu", None, "Image", "Date-Time picker", None, None, "Badge", None)


@query("lbl02_from_type", f"SELECT p_partkey, {sql_pick(_TYPE_CLASS, 'p_partkey')} AS label FROM part")
def lbl02(spark, d):
    return table(spark, d, "part").select("p_partkey", L.class_from_type(pick(_TYPES, F.col("p_partkey"))).alias("label"))


@query("lbl03_export_class", f"{LABELS_SQL} SELECT screen, seq, class_name FROM labels")
def lbl03(spark, d):
    return elements(spark, d).select("screen", "seq", L.export_class(F.col("label"), F.col("type")).alias("class_name"))


@query("lbl05_answer_objects", "SELECT event_id, CASE WHEN event_id % 4 IN (0, 3) THEN CAST(regexp_extract(props, '[0-9]+') AS BIGINT) END AS k FROM events")
def lbl05(spark, d):
    said = _answers(spark, d).withColumn("text", F.concat(F.lit("It is\n"), "text", F.lit("\ndone")))
    return said.select("event_id", F.try_variant_get(model_io.answer_object(F.col("text")), "$.k", "bigint").alias("k"))


@query("lbl06_booleans", "SELECT p_partkey, p_partkey % 8 IN (0, 1, 2, 5, 6) AS v FROM part")
def lbl06(spark, d):
    return table(spark, d, "part").select("p_partkey", L.as_boolean(pick((" True", "YES", "1", "no", "0", "0.5", "t", "maybe"), F.col("p_partkey"))).alias("v"))


@query("lbl07_snippets", f"""{ELEMENTS_SQL} SELECT screen, seq, '<' || tag || CASE WHEN own_id <> '' THEN ' id="' || own_id || '"' ELSE '' END || CASE WHEN class_words <> '' THEN ' class="' || class_words || '"' ELSE '' END || ' type="' || kind || '">' || inner_text || '</' || tag || '>' AS html FROM elements""")
def lbl07(spark, d):
    return elements(spark, d).select("screen", "seq", model_io.snippet(F.col("tag"), F.col("attrs"), F.col("inner_text")).alias("html"))


@query("lbl08_prompts", f"SELECT conv_id, turn, CAST({{fixed}} + CASE WHEN length(trim(text)) > 1500 THEN 1493 ELSE length(trim(text)) END AS BIGINT) AS n_chars FROM conversations".replace("{fixed}", str(len("Allowed labels:\n- " + "\n- ".join(CLASSES) + "\n\nElement:\n") + len("\n\nAnswer with one JSON object: label and interactable."))))
def lbl08(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.length(model_io.prompt(F.col("text"))).cast("long").alias("n_chars"))


@query("lbl09_crops", f"{BOXES_SQL}, c AS (SELECT screen, seq, greatest(0, 2 * x - 5) AS crop_x, greatest(0, 2 * y - 5) AS crop_y, 2 * w + 10 AS cw, 2 * h + 10 AS ch FROM boxes), s AS (SELECT screen, seq, crop_x, crop_y, least({_W} * 2 - crop_x, cw) AS crop_w, least({_H} * 2 - crop_y, ch) AS crop_h FROM c) SELECT screen, seq, CAST(crop_x AS INTEGER) AS crop_x, CAST(crop_w AS INTEGER) AS crop_w, CAST(crop_h AS INTEGER) AS crop_h, least(crop_w, crop_h) >= 2 AND greatest(crop_w, crop_h) <= 199 * least(crop_w, crop_h) AS usable FROM s")
def lbl09(spark, d):
    made = model_io.crop(F.col("x"), F.col("y"), F.col("w"), F.col("h"), F.lit(2.0), 2 * _W, 2 * _H)
    return boxes(spark, d).select("screen", "seq", *[made[c].alias(c) for c in ("crop_x", "crop_w", "crop_h", "usable")])


class _Stub(model_io.Predictor):
    """Answers by a rule, for runs without a model."""

    schema = "label string, interactable boolean"

    def predict(self, batch):
        import pandas as pd

        return pd.DataFrame({"label": ["Button" if t == "button" else "Text" for t in batch["type"]], "interactable": [t in ("button", "link") for t in batch["type"]]})


@query("lbl10_predicted", f"{ELEMENTS_SQL} SELECT screen, seq, CASE WHEN type = 'button' THEN 'Button' ELSE 'Text' END AS label, type IN ('button', 'link') AS interactable, CAST(NULL AS VARCHAR) AS error FROM elements")
def lbl10(spark, d):
    return model_io.predicted(elements(spark, d).select("screen", "seq", "type"), ["screen", "seq"], _Stub())


@query("prd06_callable", f"{ELEMENTS_SQL} SELECT screen, seq, upper(type) AS prediction, CAST(NULL AS VARCHAR) AS error FROM elements")
def prd06(spark, d):
    return model_io.predicted(elements(spark, d).select("screen", "seq", "type"), ["screen", "seq"], model_io.CallablePredictor(lambda r: r["type"].upper()))


def _quality_answers(spark, d):
    body = F.concat(F.lit('```json\n{"short_summary": "d'), "doc_id", F.lit('", "coverage_score": '), F.col("quality") * 80 + 10, F.lit(', "false_positive_score": "7", "duplication_score": null, "localization_score": {"a": 1}, "overall_quality": '), F.col("quality") * 80 + 15 - 20 * F.col("toxic"), F.lit("}\n```"))
    return table(spark, d, "labels").select("doc_id", "quality", "toxic", body.alias("answer"))


@query("qlt01_quality_answers", "SELECT doc_id, 'd' || doc_id AS short_summary, CAST(quality * 80 + 10 AS DOUBLE) AS coverage_score, 7.0::DOUBLE AS false_positive_score, CAST(quality * 80 + 15 - 20 * toxic AS DOUBLE) AS overall_quality FROM labels")
def qlt01(spark, d):
    return model_io.quality_scores(_quality_answers(spark, d), "doc_id", "answer").select("doc_id", "short_summary", "coverage_score", "false_positive_score", "overall_quality")


@query("qlt02_safe_scores", "SELECT doc_id, 0.0::DOUBLE AS duplication_score, 0.0::DOUBLE AS localization_score FROM labels")
def qlt02(spark, d):
    return model_io.quality_scores(_quality_answers(spark, d), "doc_id", "answer").select("doc_id", "duplication_score", "localization_score")


@query("qlt03_score_summary", "SELECT quality * 80 + 15 - 20 * toxic >= 70 AS accepted, count(*) AS n, round(avg(quality * 80 + 10), 6) AS avg_coverage FROM labels GROUP BY 1")
def qlt03(spark, d):
    return model_io.quality_scores(_quality_answers(spark, d), "doc_id", "answer", QUALITY).groupBy("accepted").agg(F.count("*").alias("n"), F.round(F.avg("coverage_score"), 6).alias("avg_coverage"))


@query("qlt04_weighted", "SELECT doc_id, round(0.4::DOUBLE * (quality * 80 + 10) + 0.25 * 7, 6) AS weighted FROM labels")
def qlt04(spark, d):
    s = model_io.quality_scores(_quality_answers(spark, d), "doc_id", "answer")
    w = 0.4 * F.col("coverage_score") + 0.25 * F.col("false_positive_score") + 0.2 * F.col("duplication_score") + 0.15 * F.col("localization_score")
    return s.select("doc_id", F.round(w, 6).alias("weighted"))


@query("qlt05_raw_paths", "SELECT 'out/raw/p' || page_id || '.png' AS path FROM pages WHERE page_id % 3 <> 0")
def qlt05(spark, d):
    p = table(spark, d, "pages").select(F.concat(F.lit("out/viz/p"), "page_id", F.when(F.col("page_id") % 3 == 0, ".jpg").otherwise(".viz.jpg")).alias("path"))
    return p.where(F.endswith("path", F.lit(".viz.jpg"))).select(F.regexp_replace("path", r"[^/]+/([^/]+)\.viz\.jpg$", "raw/$1.png").alias("path"))


# Export and validation


@query("exp01_unit_boxes", f"{LABELS_SQL} SELECT screen, seq, round(cx, 6) AS cx, round(cy, 6) AS cy, round(bw, 6) AS bw, round(bh, 6) AS bh FROM labels")
def exp01(spark, d):
    return _label_rows(spark, d).select("screen", "seq", *[F.round(c, 6).alias(c) for c in ("cx", "cy", "bw", "bh")])


@query("exp02_export_clean")
def exp02(spark, d):
    return _label_rows(spark, d, clean=True)


@query("exp03_split_stats", f"{LABELS_SQL} SELECT split, count(DISTINCT screen) AS n_screens, count(*) AS n_labels FROM labels GROUP BY ROLLUP (split)")
def exp03(spark, d):
    return export.split_stats(_label_rows(spark, d), "screen")


@query("val01_report", """WITH i AS (SELECT o_orderkey % 3 AS split, o_orderkey % 10 AS k FROM orders)
SELECT split, count(*) AS n_images, count(*) FILTER (k = 7) AS n_missing, count(*) FILTER (k NOT IN (6, 7)) + count(*) FILTER (k IN (2, 3, 5)) AS n_annotations,
count(*) FILTER (k IN (1, 2, 4)) AS n_invalid, count(*) FILTER (k IN (3, 5)) AS n_box, round((count(*) FILTER (k NOT IN (6, 7)) + count(*) FILTER (k IN (2, 3, 5))) / count(*), 6) AS avg_boxes FROM i GROUP BY ROLLUP (split)""")
def val01(spark, d):
    images = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("split"), F.col("o_orderkey").alias("stem"))
    return validate.report(images, _label_files(spark, d).where("stem % 10 <> 7"))


@query("val02_issues", "SELECT CASE o_orderkey % 10 WHEN 1 THEN 'values' WHEN 2 THEN 'class' WHEN 4 THEN 'parse' ELSE 'box' END AS issue, count(*) AS n FROM orders WHERE o_orderkey % 10 BETWEEN 1 AND 5 GROUP BY 1")
def val02(spark, d):
    return validate.checked(_label_files(spark, d)).where("issue <> 'none'").groupBy("issue").agg(F.count("*").alias("n"))


@query("val03_data_config", """SELECT 'd' || p_partkey AS path, CASE p_partkey % 4 WHEN 1 THEN 'names' WHEN 2 THEN 'path,train,val,nc,names' ELSE '' END AS missing,
CASE WHEN p_partkey % 4 <> 2 AND p_partkey % 5 = 0 THEN '/data/' || p_partkey || '/images/val' ELSE '' END AS absent, p_partkey % 4 IN (0, 3) AS valid FROM part""")
def val03(spark, d):
    k = F.col("p_partkey")
    head = F.concat(F.lit("# made by hand\npath: /data/"), k, F.lit("/\ntrain: 'images/train'\nval: images/val  # small\nnc: 2\n"))
    text = F.when(k % 4 == 0, F.concat(head, F.lit("names:\n  0: a\n  test: b\n"))).when(k % 4 == 1, head).when(k % 4 == 3, F.concat(F.lit('{"path": "/data/'), k, F.lit('", "train": "images/train", "val": "images/val", "nc": 1, "names": ["a"]}'))).otherwise("")
    p = table(spark, d, "part")
    there = p.select(F.explode(F.array(*[F.when((k % 5 != 0) | F.lit(s == "train"), F.concat(F.lit("/data/"), k, F.lit(f"/images/{s}"))) for s in ("train", "val")])).alias("path")).where("path IS NOT NULL")
    got = validate.configs(p.select(F.concat(F.lit("d"), k).alias("path"), text.alias("text")), there)
    return got.select("path", F.array_join("missing", ",").alias("missing"), F.array_join("absent", ",").alias("absent"), "valid")


def _map_sql(schema):
    if schema == "eight":
        cases = " ".join(f"WHEN label IN ({_quoted(v)}) THEN '{k}'" for k, v in EIGHT_OF.items())
        return f"CASE {cases} ELSE label END"
    return f"CASE WHEN label IN ({_quoted(TWO_TEXT)}) THEN 'text' ELSE 'icon' END"


@query("map01_eight", f"{EVAL_SQL} SELECT screen, seq, {_map_sql('eight')} AS label FROM gt")
def map01(spark, d):
    return truth(spark, d).select("screen", "seq", L.map_label(F.col("label"), "eight").alias("label"))


@query("map01_two", f"{EVAL_SQL} SELECT screen, seq, {_map_sql('two')} AS label FROM gt")
def map01two(spark, d):
    return truth(spark, d).select("screen", "seq", L.map_label(F.col("label"), "two").alias("label"))


_FOREIGN = ("Input Element", "icon", "Others", "Button", "mystery")


@query("map02_to_classes", f"SELECT p_partkey, {sql_pick(('Text Input', 'Image', 'Link', 'Button', 'mystery'), 'p_partkey')} AS label FROM part")
def map02(spark, d):
    return table(spark, d, "part").select("p_partkey", L.map_label(pick(_FOREIGN, F.col("p_partkey")), "classes").alias("label"))


@query("map03_ocr_labels", f"SELECT p_partkey, {sql_pick(('Heading', 'Text', 'Chart Title', None), 'p_partkey')} AS label FROM part")
def map03(spark, d):
    return table(spark, d, "part").select("p_partkey", L.ocr_label(pick(("header", "footnote", "chart title", None), F.col("p_partkey"))).alias("label"))


@query("ext10_element_texts", f"""{BOXES_SQL}, c AS (SELECT screen, seq, greatest(0, CAST(round_even((x - 200) * 0.5, 0) AS BIGINT)) AS l, greatest(0, CAST(round_even(y * 0.5, 0) AS BIGINT)) AS t, CAST(round_even(w * 0.5, 0) AS BIGINT) AS w, CAST(round_even(h * 0.5, 0) AS BIGINT) AS h FROM boxes)
SELECT screen, seq AS element_index, l || ',' || t || ',' || (least(l + w, 500) - l) || ',' || (least(t + h, 400) - t) AS text FROM c WHERE least(l + w, 500) > l AND least(t + h, 400) > t AND (l + t) % 3 <> 0""")
def ext10(spark, d):
    """The recogniser is a stub that writes the crop it got, with blanks around, or nothing."""
    read = model_io.CallablePredictor(lambda r: "  " if (r["left"] + r["top"]) % 3 == 0 else f" {r['left']},{r['top']},{r['width']},{r['height']} ", "text string")
    b = boxes(spark, d).select("screen", "seq", (F.col("x") - 200).alias("x"), "y", "w", "h", F.lit(500).alias("image_width"), F.lit(400).alias("image_height"))
    return model_io.element_texts(b, ["screen"], "seq", read, 0.5)


@query("prd01_answers", f"{BOXES_SQL} SELECT screen, seq, CASE WHEN part % 2 = 0 THEN 'Button' ELSE 'Link' END AS label, round(least(1000, part % 1200) / 1000.0 * {_W}, 6) AS x, round(least(1000, 10 + part % 50) / 1000.0 * {_H}, 6) AS y, 0.25::DOUBLE AS score FROM boxes WHERE part % 4 <> 3")
def prd01(spark, d):
    b = boxes(spark, d)
    l, t = F.col("part") % 1200, 10 + F.col("part") % 50  # noqa: E741
    box = F.when(F.col("part") % 2 == 0, F.format_string('"bbox_tlbr":[%d,%d,%d,%d]', t, l, t + 20, l + 30)).otherwise(F.format_string('"bbox":[%d,%d,%d,%d]', l, t, l + 30, t + 20))
    label = F.when(F.col("part") % 2 == 0, '["", "Button"]').otherwise('"Link"')
    answer = F.concat(F.lit('Here: [{"label":'), label, F.lit(',"score":["0.25"],'), box, F.when(F.col("part") % 4 == 3, "").otherwise("}] end"))
    got = model_io.answers_to_elements(b.select((F.col("screen") * 1000 + F.col("seq")).alias("id"), answer.alias("answer")), "id", "answer", _W, _H)
    return got.select(F.floor(F.col("id") / 1000).alias("screen"), (F.col("id") % 1000).alias("seq"), "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "score")


@query("prd04_detections", f"{EVAL_SQL} SELECT screen, seq, CAST(least({_W - 1}, greatest(0, x + w)) AS BIGINT) AS x2, label FROM pred WHERE score >= 0.5")
def prd04(spark, d):
    p = predictions(spark, d).where(F.col("score") >= 0.5)
    return p.select("screen", "seq", F.greatest(F.lit(0), F.least(F.lit(_W - 1), F.col("x") + F.col("w"))).cast("long").alias("x2"), "label")


@query("prd05_union", f"{EVAL_SQL} SELECT screen, count(*) AS n FROM (SELECT screen FROM pred UNION ALL SELECT screen FROM gt) GROUP BY screen")
def prd05(spark, d):
    both = predictions(spark, d).select("screen", "label").unionByName(truth(spark, d).select("screen", "label"))
    return both.groupBy("screen").agg(F.count("*").alias("n"))


@query("prd07_inference")
def prd07(spark, d):
    """Detections to hierarchy, own text and markup."""
    p = predictions(spark, d).where(F.col("score") >= 0.25).withColumns({"klass": F.col("label"), "tag": F.lit("div"), "type": F.lit(None).cast("string"), "inner_text": F.col("text")})
    tree = hierarchy.parents(p, KEYS, 0.9, semantic=True, strict=True)
    own = hierarchy.own_texts(tree, KEYS, ("parent", *"xywh", "label", "type", "tag"))
    return hierarchy.serialize(own.withColumn("text", F.col("own_text")), KEYS)


# Metrics


@query("met01_page_iou")
def met01(spark, d):
    cells = metrics.page_cells(truth(spark, d), predictions(spark, d), KEYS, _W, _H)
    return cells.select("screen", F.round(F.col("inter") / F.col("n_union"), 6).alias("page_iou"))


@query("met02_page_recall")
def met02(spark, d):
    cells = metrics.page_cells(truth(spark, d), predictions(spark, d), KEYS, _W, _H)
    return cells.select("screen", F.round(F.col("inter") / F.col("n_gt"), 6).alias("page_recall"))


@query("met03_label_page_iou")
def met03(spark, d):
    cells = metrics.label_cells(truth(spark, d), predictions(spark, d), KEYS, _W, _H)
    return cells.select("screen", F.round(F.col("match") / F.col("n_union"), 6).alias("label_page_iou"))


@query("met04_mean_ap")
def met04(spark, d):
    gt = truth(spark, d)
    pairs = metrics.matches(gt, predictions(spark, d), KEYS)
    ap = metrics.average_precision(pairs, gt.groupBy("label").agg(F.count("*").alias("n_gt")), ["label"], ["screen", "seq"])
    return ap.where("n_gt > 0").agg(F.round(F.avg("ap"), 6).alias("mean_ap"), F.count("*").alias("n_classes"))


@query("met05_average_precision", f"""{EVAL_SQL}, q AS (SELECT label, score, screen, seq, (screen + seq) % 3 = 0 AS tp FROM pred), n AS (SELECT label, count(*) AS n_gt FROM gt GROUP BY label),
o AS (SELECT *, row_number() OVER w AS rn, sum(tp::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS tps FROM q WINDOW w AS (PARTITION BY label ORDER BY score DESC, screen, seq)),
e AS (SELECT label, tp, max(tps / rn) OVER (PARTITION BY label ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS env FROM o)
SELECT label, n_gt, round(coalesce((SELECT sum(env) FROM e WHERE e.label = n.label AND tp), 0) / n_gt, 6) AS ap FROM n""")
def met05(spark, d):
    pairs = predictions(spark, d).select("label", "score", "screen", "seq", ((F.col("screen") + F.col("seq")) % 3 == 0).alias("tp"))
    n = truth(spark, d).groupBy("label").agg(F.count("*").alias("n_gt"))
    return metrics.average_precision(pairs, n, ["label"], ["screen", "seq"]).select("label", "n_gt", F.round("ap", 6).alias("ap"))


@query("met06_recall")
def met06(spark, d):
    r = metrics.recall(truth(spark, d), predictions(spark, d), KEYS)
    return r.agg(F.sum("tp").alias("tp"), F.sum("n_gt").alias("n_gt"), F.round(F.sum("tp") / F.sum("n_gt"), 6).alias("recall"))


@query("met06_recall_any_label")
def met06any(spark, d):
    r = metrics.recall(truth(spark, d), predictions(spark, d), KEYS, by_label=False)
    return r.agg(F.sum("tp").alias("tp"), F.sum("n_gt").alias("n_gt"), F.round(F.sum("tp") / F.sum("n_gt"), 6).alias("recall"))


@query("met07_edit_distance")
def met07(spark, d):
    c = metrics.edit_distances(truth(spark, d), predictions(spark, d), KEYS)
    return c.agg(F.sum("n_gt").alias("n_gt"), F.round(F.sum("cost") / F.sum("n_gt"), 6).alias("ned"))


@query("met07_edit_distance_gated")
def met07g(spark, d):
    c = metrics.edit_distances(truth(spark, d), predictions(spark, d), KEYS, gate=0.5)
    return c.agg(F.sum("n_gt").alias("n_gt"), F.round(F.sum("cost") / F.sum("n_gt"), 6).alias("ned"))


@query("met09_text_distance", "SELECT p_partkey, round(levenshtein(lower(p_name), lower(p_type)) / greatest(length(p_name), length(p_type)), 6) AS distance FROM part")
def met09(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(metrics.distance(F.lower("p_name"), F.lower("p_type")), 6).alias("distance"))


@query("met08_assignment")
def met08(spark, d):
    """Text costs of each screen's cheapest assignment."""
    return metrics.edit_distances(truth(spark, d), predictions(spark, d), KEYS).select("screen", "n_gt", "n_pred", F.round("cost", 6).alias("cost"))


@query("met10_truth_overlap", f"{EVAL_SQL}, p AS (SELECT a.screen, a.seq AS gt, b.seq AS pred, {INTER_SQL} AS inter, a.w * a.h + b.w * b.h AS s FROM gt a JOIN pred b ON a.screen = b.screen) SELECT screen, gt, pred, round(inter / (s - inter), 6) AS iou FROM p WHERE 2 * inter > s - inter")
def met10(spark, d):
    pairs = metrics.overlapping(truth(spark, d), predictions(spark, d).select("screen", "seq", *"xywh"), KEYS)
    value = iou(Box.of("a_"), Box.of("b_"))
    return pairs.where(value > 0.5).select("screen", F.col("a_seq").alias("gt"), F.col("b_seq").alias("pred"), F.round(value, 6).alias("iou"))


@query("met11_means", "SELECT event_type AS metric, round(avg(CASE WHEN event_id % 5 <> 0 THEN value END), 6) AS mean, count(CASE WHEN event_id % 5 <> 0 THEN value END) AS n FROM events GROUP BY 1")
def met11(spark, d):
    e = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 5 != 0, F.col("value")))
    return e.groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg("v"), 6).alias("mean"), F.count("v").alias("n"))


@query("met12_failed_batches", f"{EVAL_SQL} SELECT screen % 5 = 0 AS failed, count(*) AS n FROM gt GROUP BY 1")
def met12(spark, d):
    """Predictions of a batch that fails are null with an error; its rows stay."""

    class Fails(model_io.Predictor):
        schema = "label string"

        def predict(self, batch):
            import pandas as pd

            return pd.DataFrame({"label": [None if s % 5 == 0 else "x" for s in batch["screen"]]})

    got = model_io.predicted(truth(spark, d).select("screen", "seq"), ["screen", "seq"], Fails())
    return got.groupBy(F.col("label").isNull().alias("failed")).agg(F.count("*").alias("n"))


_ASKED = ("page_iou", "page_iou_rec", "labelawarepageiou", "map50", "recall", "recall_nolabel", "normalized_edit_distance", "f1")


@query("met13_aliases", """SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'page_iou' WHEN 1 THEN 'page_recall' WHEN 2 THEN 'label_page_iou' WHEN 3 THEN 'map' WHEN 4 THEN 'recall_label' WHEN 5 THEN 'recall_any' WHEN 6 THEN 'ned' END AS measure FROM part""")
def met13(spark, d):
    return table(spark, d, "part").select("p_partkey", metrics.measure_of(pick(_ASKED, F.col("p_partkey"))).alias("measure"))


@query("met14_model_matrix", "SELECT 'm' || (user_id % 3) AS model, event_type AS metric, sum(CAST(round_even(value * 100, 0) AS BIGINT))::BIGINT AS cents FROM events GROUP BY ALL")
def met14(spark, d):
    return table(spark, d, "events").groupBy(F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.col("event_type").alias("metric")).agg(F.sum(F.rint(F.col("value") * 100).cast("long")).alias("cents"))


@query("met15_timing", "SELECT event_type, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(stddev_samp(value), 6) AS sd, round(1000 / avg(value), 6) AS per_second FROM events GROUP BY 1")
def met15(spark, d):
    """Exact medians are one sort a group; percentile_approx is there for groups too large for that."""
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(1000 / F.avg("value"), 6).alias("per_second"))


@query("met16_rounded_boxes", f"{BOXES_SQL}, c AS (SELECT screen, seq, least({_W}, x) AS x1, least({_W}, x + w) AS x2, least({_H}, y) AS y1, least({_H}, y + h) AS y2 FROM boxes) SELECT screen, seq, CAST(round_even(x1 / 2.0, 0) AS BIGINT) AS x, CAST(round_even((x2 - x1) / 2.0, 0) AS BIGINT) AS w FROM c WHERE round_even((x2 - x1) / 2.0, 0) > 0 AND round_even((y2 - y1) / 2.0, 0) > 0")
def met16(spark, d):
    return metrics.clamped(boxes(spark, d).select("screen", "seq", *"xywh"), _W, _H, _W // 2).select("screen", "seq", "x", "w")


