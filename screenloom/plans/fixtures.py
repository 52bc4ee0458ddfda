"""Screens, elements, truths and predictions derived from the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.elements import TYPE_RULES, guess_type
from ..schema import CLASSES, PROTECTED_ROLES, PROTECTED_TAGS, PROTECTED_TYPES

KEYS = ["screen"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    """The value of a short fixed list at ``index`` modulo its length; None gives null."""
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (index % len(values) + 1).cast("int"))


def sql_pick(values, index: str) -> str:
    inner = ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"([{inner}])[1 + ({index}) % {len(values)}]"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """screen, seq, x, y, w, h, cls of every line item; a screen for each ten orders, so screens stay the same size."""
    k = max(1, table(spark, sf_dir, "orders").count() // 10)
    c = F.col
    r = table(spark, sf_dir, "lineitem").withColumns({"gx": (c("l_partkey") * 37) % 14, "gy": (c("l_suppkey") * 53 + c("l_linenumber") * 29) % 10, "screen": c("l_orderkey") % k})
    order = Window.partitionBy("screen").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    ln = c("l_linenumber")
    return r.select(
        "screen", (F.row_number().over(order) - 1).cast("long").alias("seq"),
        (c("gx") * 100 + c("l_suppkey") % 9).alias("x"), (c("gy") * 86 + c("l_partkey") % 7).alias("y"),
        F.when(ln == 7, 320 + c("l_partkey") % 80).when(ln == 6, 90 + c("l_partkey") % 5).otherwise(70 + c("l_partkey") % 25).alias("w"),
        F.when(ln == 7, 240 + c("l_suppkey") % 60).when(ln == 6, 60 + c("l_suppkey") % 5).otherwise(25 + c("l_quantity").cast("long")).alias("h"),
        ((c("gx") * 7 + c("gy") + F.when(ln % 3 == 0, 1).otherwise(0)) % 55).cast("int").alias("cls"),
        c("l_partkey").alias("part"), c("l_suppkey").alias("supp"), ln.cast("long").alias("line"),
    )


TAGS = ("div", "p", "a", "button", "span", "li", "path", "img", "input", "svg", "section")
ROLES = (None, None, "button", "navigation", None, "link", "main", None)
WORDS = ("", "btn primary", "row wrapper", "card item", "nav-link", "icon small", "ad-slot", "content", "container grid")
IDS = ("", "main", "promo", "menu-3", "x1")


def elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes with tag, role, attrs, type, text and a parent each."""
    b = boxes(spark, sf_dir)
    b = b.withColumns({
        "tag": pick(TAGS, F.col("part")), "role": pick(ROLES, F.col("supp")), "class_words": pick(WORDS, F.col("part") + F.col("line")), "own_id": pick(IDS, F.col("part") + F.col("supp")),
        "aria_hidden": F.when(F.col("part") % 23 == 0, "true"), "parent": F.when(F.col("seq") > 0, F.floor((F.col("seq") - 1) / 2)),
        "inner_text": F.concat(F.lit("item "), F.col("part") % 100, F.lit(" of lot "), F.col("supp") % 10),
        "label": F.when(F.col("part") % 5 == 0, pick(CLASSES, F.col("cls"))).when(F.col("part") % 5 == 1, "unknown"),
    })
    attrs = F.create_map(F.lit("class"), F.col("class_words"), F.lit("id"), F.col("own_id"), F.lit("type"), F.when(F.col("line") % 2 == 0, "text").otherwise("submit"))
    attrs = F.map_concat(attrs, F.when(F.col("part") % 31 == 0, F.create_map(F.lit("onclick"), F.lit("go()"))).otherwise(F.create_map().cast("map<string,string>")))
    return b.withColumn("attrs", attrs).withColumn("type", guess_type(F.col("tag"), F.col("role"), F.col("attrs")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """screen, seq, box, label, text; a seventh of the rows has text."""
    b = boxes(spark, sf_dir)
    text = F.when(F.col("line") == 1, F.concat(F.lit("part "), F.col("part") % 50, F.lit(" lot "), F.col("supp") % 7)).otherwise("")
    return b.select("screen", "seq", *"xywh", pick(CLASSES, F.col("cls")).alias("label"), text.alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The truths, shifted by up to 3 pixels, less every fifth line; a class in eleven is wrong; scores tie often."""
    b = boxes(spark, sf_dir).where("line <> 5")
    cls = (F.col("cls") + F.when(F.col("part") % 11 == 0, 1).otherwise(0)) % 55
    text = F.when(F.col("line") == 1, F.concat(F.lit("part "), F.col("part") % 50, F.lit(" lot "), F.col("supp") % 5)).otherwise("")
    return b.select("screen", "seq", (F.col("x") + F.col("supp") % 7 - 3).alias("x"), (F.col("y") + F.col("part") % 5 - 2).alias("y"), "w", "h", pick(CLASSES, cls).alias("label"), text.alias("text"), (((F.col("part") * 31 + F.col("supp") * 17) % 1000) / 1000.0).alias("score"))


def _quoted(xs) -> str:
    return ", ".join("'" + x + "'" for x in xs)


def type_sql() -> str:
    out = []
    for name, tags, roles, words in TYPE_RULES:
        plain, kinds = [t for t in tags if ":" not in t], [t.split(":")[1] for t in tags if ":" in t]
        tests = [f"tag IN ({_quoted(plain)})"] * bool(plain) + [f"(tag = 'input' AND kind IN ({_quoted(kinds)}))"] * bool(kinds) + [f"coalesce(role, '') IN ({_quoted(roles)})"] * bool(roles) + [f"contains(class_words, '{w}')" for w in words]
        out.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    ad = r"\b(ad|ads|ad-slot|promo)\b"
    return f"CASE {' '.join(out)} WHEN regexp_matches(class_words, '{ad}') OR regexp_matches(own_id, '{ad}') THEN 'ad' WHEN tag IN ('p', 'span', 'div', 'section', 'main') AND coalesce(role, '') IN ('', 'text') THEN 'text' ELSE tag END"


BOXES_SQL = """WITH k AS MATERIALIZED (SELECT greatest(1, count(*) // 10) AS k FROM orders),
r AS MATERIALIZED (SELECT *, (l_partkey * 37) % 14 AS gx, (l_suppkey * 53 + l_linenumber * 29) % 10 AS gy, l_orderkey % (SELECT k FROM k) AS screen FROM lineitem),
boxes AS MATERIALIZED (
  SELECT screen, row_number() OVER (PARTITION BY screen ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS seq,
         gx * 100 + l_suppkey % 9 AS x, gy * 86 + l_partkey % 7 AS y,
         CASE WHEN l_linenumber = 7 THEN 320 + l_partkey % 80 WHEN l_linenumber = 6 THEN 90 + l_partkey % 5 ELSE 70 + l_partkey % 25 END AS w,
         CASE WHEN l_linenumber = 7 THEN 240 + l_suppkey % 60 WHEN l_linenumber = 6 THEN 60 + l_suppkey % 5 ELSE 25 + CAST(l_quantity AS BIGINT) END AS h,
         CAST((gx * 7 + gy + CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END) % 55 AS INTEGER) AS cls,
         l_partkey AS part, l_suppkey AS supp, CAST(l_linenumber AS BIGINT) AS line
  FROM r)"""
ELEMENTS_SQL = f"""{BOXES_SQL},
raw AS MATERIALIZED (
  SELECT *, {sql_pick(TAGS, "part")} AS tag, {sql_pick(ROLES, "supp")} AS role, {sql_pick(WORDS, "part + line")} AS class_words, {sql_pick(IDS, "part + supp")} AS own_id,
         CASE WHEN part % 23 = 0 THEN 'true' END AS aria_hidden, CASE WHEN seq > 0 THEN (seq - 1) // 2 END AS parent,
         'item ' || (part % 100) || ' of lot ' || (supp % 10) AS inner_text, CASE WHEN part % 5 = 0 THEN {sql_pick(CLASSES, "cls")} WHEN part % 5 = 1 THEN 'unknown' END AS label,
         CASE WHEN line % 2 = 0 THEN 'text' ELSE 'submit' END AS kind, part % 31 = 0 AS onclick
  FROM boxes),
typed AS MATERIALIZED (SELECT *, {type_sql()} AS type FROM raw),
elements AS MATERIALIZED (
  SELECT *, (type IN ({_quoted(PROTECTED_TYPES)}) OR coalesce(role, '') IN ({_quoted(PROTECTED_ROLES)}) OR tag IN ({_quoted(PROTECTED_TAGS)}) OR onclick) AS protected,
         CASE WHEN lower(coalesce(label, '')) NOT IN ('', 'unknown') THEN label ELSE type END AS klass
  FROM typed)"""
EVAL_SQL = f"""{BOXES_SQL},
gt AS MATERIALIZED (SELECT screen, seq, x, y, w, h, {sql_pick(CLASSES, "cls")} AS label FROM boxes),
pred AS MATERIALIZED (SELECT screen, seq, x + supp % 7 - 3 AS x, y + part % 5 - 2 AS y, w, h, {sql_pick(CLASSES, "cls + CASE WHEN part % 11 = 0 THEN 1 ELSE 0 END")} AS label,
                ((part * 31 + supp * 17) % 1000) / 1000.0 AS score FROM boxes WHERE line <> 5)"""
INTER_SQL = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
