"""Queries on URLs, element typing, filters and hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions import urls as U
from ..functions.geometry import Box, containment, iou, nearly_equal, overlapping, viewport_share
from ..functions.text import normalize, truncate
from ..operators import filters, hierarchy
from ..schema import INTERACTIVE_WORDS, LAYOUT_WORDS, MAX_AREA, MEANINGFUL_ROLES, SEMANTIC_WORDS, TEXT_TAGS, VIEWPORT_H, VIEWPORT_W
from ..sources import readers
from ..streaming.incremental import pending
from .fixtures import ELEMENTS_SQL, INTER_SQL, KEYS, _quoted, elements, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", "url")


_CANON = r"""regexp_extract(url, '^([a-z]+)://', 1) || '://' || regexp_extract(url, '://([^/?#]*)', 1) || regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ||
 coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT starts_with(lower(p), 'utm_'))), '&'), ''), '')"""
_STEM = r"""substr(trim(regexp_replace(lower(regexp_extract(url, '://([^/?#]*)', 1) || '-' || regexp_extract(url, '://[^/?#]*([^?#]*)', 1)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 80)"""


@query("url01_canonical", f"SELECT page_id, {_CANON} AS canonical FROM pages")
def url01(spark, d):
    return _pages(spark, d).select("page_id", U.canonical(F.col("url")).alias("canonical"))


@query("url02_stable_hash", "SELECT page_id, substr(sha256(url), 1, 16) AS key FROM pages")
def url02(spark, d):
    return _pages(spark, d).select("page_id", U.stable_hash(F.col("url")).alias("key"))


@query("url03_safe_stem", f"SELECT page_id, {_STEM} AS stem FROM pages")
def url03(spark, d):
    return _pages(spark, d).select("page_id", U.safe_stem(F.col("url")).alias("stem"))


@query("url04_file_base", f"SELECT page_id, {_STEM} || '-' || substr(sha256({_CANON}), 1, 16) AS base FROM pages")
def url04(spark, d):
    return _pages(spark, d).select("page_id", U.file_base(F.col("url")).alias("base"))


@query("url05_resume", f"SELECT page_id, stem FROM (SELECT page_id, {_STEM} AS stem FROM pages) WHERE stem NOT IN (SELECT {_STEM} FROM pages WHERE page_id % 3 = 0)")
def url05(spark, d):
    p = _pages(spark, d).withColumn("stem", U.safe_stem(F.col("url")))
    return pending(p.where("page_id % 3 = 0"), p, "stem").select("page_id", "stem")


@query("url06_chunks", "SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // CAST(ceil((SELECT count(*) FROM pages) / 8.0) AS BIGINT) AS chunk FROM pages")
def url06(spark, d):
    """Contiguous chunks by rank: ranks come from counts by range, so no task sorts the whole list."""
    p = _pages(spark, d).select("page_id")
    size = -(-p.count() // 8) or 1
    ranged = p.repartitionByRange("page_id").sortWithinPartitions("page_id").withColumn("part", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id())
    within = ranged.withColumn("i", F.col("mid").bitwiseAND(F.lit((1 << 33) - 1)))
    before = [(r["part"], r["n"]) for r in within.groupBy("part").agg(F.count("*").alias("n")).collect()]  # a row a partition
    starts = {part: sum(n for q, n in before if q < part) for part, _ in before}
    shift = F.create_map(*[F.lit(v) for kv in starts.items() for v in kv]) if starts else F.lit(None)
    rank = F.col("i") + (shift[F.col("part")] if starts else F.lit(0))
    return within.select("page_id", F.floor(rank / size).cast("long").alias("chunk"))


@query("url07_shards", "SELECT page_id, page_id % 4 AS shard FROM pages")
def url07(spark, d):
    return _pages(spark, d).select("page_id", F.pmod("page_id", F.lit(4)).alias("shard"))


def _split_sql(train, val):
    r = f"('0x' || substr(md5('42/' || {_STEM}), 1, 15))::BIGINT / {16**15}.0::DOUBLE"
    return f"SELECT page_id, CASE WHEN {r} < {train} THEN 'train' WHEN {r} < {train + val} THEN 'val' ELSE 'test' END AS split FROM pages"


@query("url08_split", _split_sql(0.7, 0.2))
def url08(spark, d):
    return _pages(spark, d).select("page_id", U.split_of(U.safe_stem(F.col("url")), 0.7, 0.2, 0.1).alias("split"))


@query("url11_split_other_ratios", _split_sql(0.9, 0.05))
def url11(spark, d):
    return _pages(spark, d).select("page_id", U.split_of(U.safe_stem(F.col("url")), 0.9, 0.05, 0.05).alias("split"))


@query("url09_frame_kind", "SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'ad' WHEN 1 THEN 'tracking' WHEN 2 THEN 'tracking' ELSE 'content' END AS kind FROM pages")
def url09(spark, d):
    host = F.when(F.col("page_id") % 5 == 0, "x.DoubleClick.net").when(F.col("page_id") % 5 == 1, "www.hotjar.com").otherwise(U.part(F.col("url"), 2))
    size = F.when(F.col("page_id") % 5 == 2, 1).otherwise(300)
    return _pages(spark, d).select("page_id", U.frame_kind(host, size, F.lit(200)).alias("kind"))


@query("url10_redirected", f"SELECT page_id, url <> {_CANON} AS redirected FROM pages")
def url10(spark, d):
    return _pages(spark, d).select("page_id", (F.col("url") != U.canonical(F.col("url"))).alias("redirected"))


@query("ext01_visibility")
def ext01(spark, d):
    dom = readers.dom_elements(table(spark, d, "pages"), "page_id")
    return dom.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.col("visible").cast("long")).alias("n_visible"))


@query("ext02_dom_tags", "SELECT page_id, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<(p|li|article|nav|h1|footer|body|ul)[ >]', 1)) AS tag FROM pages) GROUP BY page_id")
def ext02(spark, d):
    dom = readers.dom_elements(table(spark, d, "pages"), "page_id")
    return dom.where(F.col("tag").isin("p", "li", "article", "nav", "h1", "footer", "body", "ul")).groupBy("page_id").agg(F.count("*").alias("n"))


@query("ext03_dom_tree")
def ext03(spark, d):
    return readers.dom_elements(table(spark, d, "pages"), "page_id").select("page_id", "dom_index", "parent", "visible_parent", "depth", "tag", "n_children")


@query("ext04_text_spans")
def ext04(spark, d):
    dom = readers.dom_elements(table(spark, d, "pages"), "page_id")
    return dom.where("visible AND n_children = 0 AND inner_text <> ''").select("page_id", "dom_index", "tag", F.col("inner_text").alias("text"))


@query("ext05_frames_united", f"""{ELEMENTS_SQL}, f AS (SELECT screen, part % 3 AS frame, seq, row_number() OVER (PARTITION BY screen, part % 3 ORDER BY seq) - 1 AS i FROM elements),
n AS (SELECT screen, frame, count(*) AS n FROM f GROUP BY ALL)
SELECT f.screen, f.seq, f.i + coalesce((SELECT sum(n.n) FROM n WHERE n.screen = f.screen AND n.frame < f.frame), 0)::BIGINT AS dom_index FROM f""")
def ext05(spark, d):
    from pyspark.sql import Window

    el = elements(spark, d).select("screen", "seq", (F.col("part") % 3).alias("frame"))
    own = el.withColumn("dom_index", (F.row_number().over(Window.partitionBy("screen", "frame").orderBy("seq")) - 1).cast("long")).withColumn("up", F.lit(None).cast("long"))
    return readers.frames_united(own, "screen", "frame", "dom_index", "up").select("screen", "seq", "dom_index")


@query("ext06_rounded_rects", f"{ELEMENTS_SQL} SELECT screen, seq, CAST(round_even(x / 4.0, 0) AS BIGINT) AS x, CAST(round_even(w / 8.0, 0) AS BIGINT) AS w FROM elements")
def ext06(spark, d):
    r = lambda c, n: F.rint(F.col(c) / n).cast("long").alias(c)
    return elements(spark, d).select("screen", "seq", r("x", 4), r("w", 8))


@query("ext07_guess_type", f"{ELEMENTS_SQL} SELECT screen, seq, type FROM elements")
def ext07(spark, d):
    return elements(spark, d).select("screen", "seq", "type")


@query("ext08_blank_images", """WITH p AS (SELECT vec_id, [CASE WHEN vec_id % 3 = 0 THEN 255.0 ELSE 120.0 + 40 * v::DOUBLE END FOR v IN embedding] AS px FROM embeddings)
SELECT vec_id, len(list_filter(px, lambda v: v > 250)) > 0.99 * len(px) OR list_stddev_pop(px) < 5 AS blank FROM p""")
def ext08(spark, d):
    px = F.transform("embedding", lambda v: F.when(F.col("vec_id") % 3 == 0, F.lit(255.0)).otherwise(120.0 + 40 * v.cast("double")))
    return table(spark, d, "embeddings").select("vec_id", readers.is_blank(px).alias("blank"))


@query("ext09_sample_validity", "SELECT page_id, CASE WHEN NOT contains(html, '<a') THEN 'no elements' WHEN page_id % 7 = 0 THEN 'blank image' END AS skipped FROM pages")
def ext09(spark, d):
    return table(spark, d, "pages").select("page_id", F.when(~F.contains("html", F.lit("<a")), "no elements").when(F.col("page_id") % 7 == 0, "blank image").alias("skipped"))


@query("ext11_element_class", f"{ELEMENTS_SQL} SELECT screen, seq, klass FROM elements")
def ext11(spark, d):
    return elements(spark, d).select("screen", "seq", E.element_class(F.col("label"), F.col("type")).alias("klass"))


def _flagged(spark, d):
    return filters.with_flags(elements(spark, d))


@query("flt01_filter_elements")
def flt01(spark, d):
    return filters.filter_elements(elements(spark, d), KEYS)


_VISIBLE = f"(least(x + w, {VIEWPORT_W}) - greatest(x, 0)) * (least(y + h, {VIEWPORT_H}) - greatest(y, 0))"


@query("flt02_predicates", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements WHERE w > 1 AND h > 1 AND (w * h >= 4 OR protected) AND (w * h <= {MAX_AREA} OR type = 'image') AND x <= {VIEWPORT_W} AND y <= {VIEWPORT_H} AND least(x + w, {VIEWPORT_W}) > greatest(x, 0) AND least(y + h, {VIEWPORT_H}) > greatest(y, 0) AND 100 * {_VISIBLE} >= w * h AND NOT (tag = 'path' AND w * h < 400) AND coalesce(aria_hidden, '') <> 'true'")
def flt02(spark, d):
    return _flagged(spark, d).where(filters.passes(F.col("protected"))).select("screen", "seq")


@query("flt03_protected", f"{ELEMENTS_SQL} SELECT screen, seq, protected FROM elements")
def flt03(spark, d):
    return _flagged(spark, d).select("screen", "seq", "protected")


_INTERACTIVE = f"(onclick OR list_bool_or([contains(class_words, w) OR contains(own_id, w) FOR w IN [{_quoted(INTERACTIVE_WORDS)}]]))"


@query("flt04_interactive", f"{ELEMENTS_SQL} SELECT screen, seq, {_INTERACTIVE} AS interactive FROM elements")
def flt04(spark, d):
    return elements(spark, d).select("screen", "seq", E.is_interactive(F.col("attrs")).alias("interactive"))


@query("flt05_orphans", f"""{ELEMENTS_SQL.replace('WITH k AS', 'WITH RECURSIVE k AS', 1)}, up AS (
  SELECT screen, seq, w, parent AS at, 0 AS hop FROM elements
  UNION ALL SELECT u.screen, u.seq, u.w, e.parent, u.hop + 1 FROM up u JOIN elements e ON e.screen = u.screen AND e.seq = u.at WHERE u.hop < 12),
wide AS (SELECT u.screen, u.seq, max(e.x) AS lo, min(e.x + e.w) AS hi FROM up u JOIN elements e ON e.screen = u.screen AND e.seq = u.at WHERE u.hop < 12 AND e.w >= u.w - 5 GROUP BY ALL)
SELECT e.screen, e.seq FROM elements e JOIN wide ON wide.screen = e.screen AND wide.seq = e.seq WHERE least(hi, e.x + e.w) <= greatest(lo, e.x)""")
def flt05(spark, d):
    return filters.orphans(elements(spark, d), KEYS)


@query("flt06_suppress")
def flt06(spark, d):
    return filters.suppress(_flagged(spark, d), KEYS)


@query("flt07_remap", f"""{ELEMENTS_SQL.replace('WITH k AS', 'WITH RECURSIVE k AS', 1)}, up AS (
  SELECT screen, seq, parent AS at FROM elements WHERE part % 5 <> 0
  UNION ALL SELECT u.screen, u.seq, e.parent FROM up u JOIN elements e ON e.screen = u.screen AND e.seq = u.at WHERE e.part % 5 = 0)
SELECT u.screen, u.seq, u.at AS parent FROM up u LEFT JOIN elements e ON e.screen = u.screen AND e.seq = u.at WHERE u.at IS NULL OR e.part % 5 <> 0""")
def flt07(spark, d):
    return filters.remap(elements(spark, d).withColumn("kept", F.col("part") % 5 != 0), KEYS)


@query("flt08_wrappers", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements e WHERE tag = 'div' AND type = 'text' AND coalesce(role, '') NOT IN ({_quoted(MEANINGFUL_ROLES)}) AND NOT {_INTERACTIVE} AND EXISTS (SELECT 1 FROM elements c WHERE c.screen = e.screen AND c.parent = e.seq)")
def flt08(spark, d):
    el = elements(spark, d)
    kids = el.where("parent IS NOT NULL").groupBy("screen", F.col("parent").alias("seq")).agg(F.count("*").alias("n"))
    return el.join(kids, ["screen", "seq"]).where(E.is_wrapper(F.col("tag"), F.col("role"), F.col("type"), F.col("attrs"), F.col("n"))).select("screen", "seq")


_SAME_CHILD = "EXISTS (SELECT 1 FROM elements c WHERE c.screen = e.screen AND c.parent = e.seq AND c.inner_text = e.inner_text)"


@query("flt09_recover_text", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements e WHERE part % 5 = 0 AND tag IN ({_quoted(TEXT_TAGS)}) AND length(inner_text) >= 15 AND NOT {_SAME_CHILD} AND EXISTS (SELECT 1 FROM elements c WHERE c.screen = e.screen AND c.parent = e.seq AND c.part % 5 <> 0)")
def flt09(spark, d):
    return filters.recover(elements(spark, d).withColumn("kept", F.col("part") % 5 != 0), KEYS)


@query("flt10_leaves", f"""{ELEMENTS_SQL}, l AS (SELECT screen, seq FROM elements e WHERE NOT EXISTS (SELECT 1 FROM elements c WHERE c.screen = e.screen AND c.parent = e.seq) OR (length(inner_text) >= 15 AND NOT {_SAME_CHILD}))
SELECT screen, seq, row_number() OVER (PARTITION BY screen ORDER BY seq DESC) - 1 AS place FROM l""")
def flt10(spark, d):
    return filters.leaves(elements(spark, d).withColumn("reading_order", -F.col("seq")), KEYS)


def _pairs(spark, d):
    b = elements(spark, d).select("screen", "seq", *"xywh")
    return overlapping(b, b, KEYS).where("a_seq < b_seq")


_PAIR_SQL = f"{ELEMENTS_SQL}, p AS (SELECT a.screen, a.seq AS a_seq, b.seq AS b_seq, {INTER_SQL} AS inter, a.w * a.h AS aa, b.w * b.h AS ba FROM elements a JOIN elements b ON a.screen = b.screen AND a.seq < b.seq)"


@query("flt11_iou", f"{_PAIR_SQL} SELECT screen, a_seq, b_seq, round(inter / (aa + ba - inter), 6) AS iou FROM p WHERE inter > 0")
def flt11(spark, d):
    return _pairs(spark, d).select("screen", "a_seq", "b_seq", F.round(iou(Box.of("a_"), Box.of("b_")), 6).alias("iou"))


@query("flt12_containment", f"{_PAIR_SQL} SELECT screen, a_seq, b_seq, round(inter / aa, 6) AS inside FROM p WHERE inter > 0")
def flt12(spark, d):
    return _pairs(spark, d).select("screen", "a_seq", "b_seq", F.round(containment(Box.of("a_"), Box.of("b_")), 6).alias("inside"))


@query("flt13_viewport_share", f"{ELEMENTS_SQL} SELECT screen, seq, round(greatest(0, least(x + w, 800) - x) * greatest(0, least(y + h, 600) - y) / (w * h), 6) AS share FROM elements")
def flt13(spark, d):
    return elements(spark, d).select("screen", "seq", F.round(viewport_share(Box.of(), 800, 600), 6).alias("share"))


@query("flt14_valid_box", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements WHERE w BETWEEN 75 AND 300 AND h BETWEEN 30 AND 200")
def flt14(spark, d):
    return elements(spark, d).where(F.col("w").between(75, 300) & F.col("h").between(30, 200)).select("screen", "seq")


@query("flt15_layout_shells", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements WHERE tag IN ('div', 'span') AND part % 2 = 0 AND list_bool_or([contains(class_words, w) FOR w IN [{_quoted(LAYOUT_WORDS)}]]) AND NOT list_bool_or([contains(class_words, w) OR contains(own_id, w) FOR w IN [{_quoted(SEMANTIC_WORDS)}]])")
def flt15(spark, d):
    el = elements(spark, d)
    return el.where(E.is_layout_shell(F.col("tag"), F.lit("div"), F.col("attrs"), F.when(F.col("part") % 2 == 0, " ").otherwise(F.col("inner_text")))).select("screen", "seq")


@query("flt16_redundant_parents", f"{ELEMENTS_SQL} SELECT DISTINCT a.screen, a.seq FROM elements a JOIN elements b ON a.screen = b.screen AND a.seq <> b.seq AND lower(a.klass) = lower(b.klass) AND 100 * {INTER_SQL} > 98 * b.w * b.h WHERE NOT (a.protected AND NOT b.protected)")
def flt16(spark, d):
    return filters.redundant_parents(_flagged(spark, d), KEYS)


@query("flt17_impact", f"{ELEMENTS_SQL} SELECT type, count(*) AS n_original, count(*) FILTER (part % 4 <> 0) AS n_kept, count(*) FILTER (part % 4 = 0) AS n_removed, count(*) FILTER (part % 4 = 0 AND protected) AS n_protected_removed FROM elements GROUP BY type")
def flt17(spark, d):
    el = _flagged(spark, d)
    return filters.impact(el, el.where("part % 4 <> 0"), KEYS)


@query("flt18_empty_labels", "SELECT o_orderkey % 3 AS split, o_orderkey AS stem FROM orders WHERE o_orderkey % 10 IN (6, 7)")
def flt18(spark, d):
    o = table(spark, d, "orders").select((F.col("o_orderkey") % 3).alias("split"), F.col("o_orderkey").alias("stem"))
    files = o.where("stem % 10 <> 7").withColumn("text", F.when(F.col("stem") % 10 == 6, " \n ").otherwise("1 0.5 0.5 0.1 0.1"))
    return filters.empty_labels(o, files)


def _parents(spark, d, **how):
    return hierarchy.parents(_flagged(spark, d), KEYS, **how)


def _parent_sql(extra: str = "", least: int = 85) -> str:
    near = " AND ".join(f"abs(a.{c} - b.{c}) <= 2" for c in "xywh")
    return f"""{ELEMENTS_SQL}, c AS (SELECT a.screen, a.seq, b.seq AS p, row_number() OVER (PARTITION BY a.screen, a.seq ORDER BY b.w * b.h, b.seq) AS rn
FROM elements a JOIN elements b ON a.screen = b.screen AND a.seq <> b.seq AND b.w * b.h >= a.w * a.h AND NOT ({near}) AND 100 * {INTER_SQL} >= {least} * a.w * a.h {extra})"""


@query("hie01_parents", f"{_parent_sql()} SELECT e.screen, e.seq, c.p AS parent FROM elements e LEFT JOIN c ON c.screen = e.screen AND c.seq = e.seq AND rn = 1")
def hie01(spark, d):
    return _parents(spark, d).select("screen", "seq", "parent")


@query("hie01_parents_semantic", f"""{_parent_sql("AND b.klass NOT IN ('Text', 'Heading', 'Image', 'Logo', 'Avatar', 'Badge', 'Checkbox', 'Radiobox', 'Switch', 'Slider', 'Progress bar', 'Rating Indicator')", 95)} SELECT e.screen, e.seq, c.p AS parent FROM elements e LEFT JOIN c ON c.screen = e.screen AND c.seq = e.seq AND rn = 1""")
def hie01s(spark, d):
    return _parents(spark, d, least=0.95, semantic=True).select("screen", "seq", "parent")


@query("hie02_depths", f"""{_parent_sql("AND (b.w * b.h > a.w * a.h OR b.seq < a.seq)").replace('WITH k AS', 'WITH RECURSIVE k AS', 1)}, t AS (SELECT e.screen, e.seq, c.p AS parent FROM elements e LEFT JOIN c ON c.screen = e.screen AND c.seq = e.seq AND rn = 1),
down AS (SELECT screen, seq, 0 AS depth FROM t WHERE parent IS NULL UNION ALL SELECT t.screen, t.seq, down.depth + 1 FROM down JOIN t ON t.screen = down.screen AND t.parent = down.seq)
SELECT screen, seq, CAST(depth AS BIGINT) AS depth FROM down""")
def hie02(spark, d):
    return hierarchy.depths(_parents(spark, d, strict=True), KEYS)


@query("hie03_children", f"{ELEMENTS_SQL} SELECT screen, parent AS seq, array_to_string(list_sort(list(seq)), ',') AS children FROM elements WHERE parent IS NOT NULL GROUP BY screen, parent")
def hie03(spark, d):
    return hierarchy.children(elements(spark, d), KEYS).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


@query("hie04_nearly_equal", f"{ELEMENTS_SQL} SELECT a.screen, a.seq AS a_seq, b.seq AS b_seq FROM elements a JOIN elements b ON a.screen = b.screen AND a.seq < b.seq AND {' AND '.join(f'abs(a.{c} - b.{c}) <= 2' for c in 'xywh')}")
def hie04(spark, d):
    return _pairs(spark, d).where(nearly_equal("a_", "b_")).select("screen", "a_seq", "b_seq")


@query("hie05_area", f"{ELEMENTS_SQL} SELECT screen, sum(w * h)::BIGINT AS area FROM elements GROUP BY screen")
def hie05(spark, d):
    return elements(spark, d).groupBy("screen").agg(F.sum(Box.of().area).alias("area"))


@query("hie06_has_hierarchy", f"{ELEMENTS_SQL} SELECT screen, bool_or(parent IS NOT NULL) AS has_hierarchy FROM elements GROUP BY screen")
def hie06(spark, d):
    return elements(spark, d).groupBy("screen").agg(F.bool_or(F.col("parent").isNotNull()).alias("has_hierarchy"))


@query("hie07_leaf_class", f"{ELEMENTS_SQL} SELECT screen, seq, klass IN ('Text', 'Heading', 'Image', 'Logo', 'Avatar', 'Badge', 'Checkbox', 'Radiobox', 'Switch', 'Slider', 'Progress bar', 'Rating Indicator') AS leaf FROM elements")
def hie07(spark, d):
    from ..schema import LEAF_ONLY

    return _flagged(spark, d).select("screen", "seq", F.col("klass").isin(*LEAF_ONLY).alias("leaf"))


@query("hie08_normalized_text", r"SELECT conv_id, turn, regexp_replace(lower(trim(text, E' \t\n\r')), '\s+', ' ', 'g') AS text FROM conversations")
def hie08(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", normalize(F.col("text")).alias("text"))


@query("hie09_own_text", f"{ELEMENTS_SQL} SELECT screen, seq, CASE WHEN {_SAME_CHILD} THEN '' ELSE inner_text END AS own_text FROM elements e")
def hie09(spark, d):
    return hierarchy.own_texts(elements(spark, d), KEYS)


@query("hie11_status_counts", f"{ELEMENTS_SQL}, s AS (SELECT screen, CASE WHEN min(part) % 3 = 0 THEN 'skipped' WHEN count(*) < 30 THEN 'error' ELSE 'ok' END AS status FROM elements GROUP BY screen) SELECT status, count(*) AS n FROM s GROUP BY status")
def hie11(spark, d):
    per = elements(spark, d).groupBy("screen").agg(F.when(F.min("part") % 3 == 0, "skipped").when(F.count("*") < 30, "error").otherwise("ok").alias("status"))
    return per.groupBy("status").agg(F.count("*").alias("n"))


@query("hie12_reading_order", f"""{ELEMENTS_SQL.replace('WITH k AS', 'WITH RECURSIVE k AS', 1)}, s AS (SELECT *, row_number() OVER (PARTITION BY screen, parent ORDER BY y, x, h, w, seq) AS rank FROM elements),
t AS (SELECT screen, seq, [rank] AS path FROM s WHERE parent IS NULL UNION ALL SELECT s.screen, s.seq, list_append(t.path, s.rank) FROM t JOIN s ON s.screen = t.screen AND s.parent = t.seq)
SELECT screen, seq, row_number() OVER (PARTITION BY screen ORDER BY path) - 1 AS reading_order FROM t""")
def hie12(spark, d):
    return hierarchy.reading_order(elements(spark, d), KEYS)


@query("hie13_roots", f"{ELEMENTS_SQL} SELECT screen, array_to_string(list_sort(list(seq)), ',') AS roots FROM elements WHERE parent IS NULL GROUP BY screen")
def hie13(spark, d):
    return elements(spark, d).where("parent IS NULL").groupBy("screen").agg(F.array_join(F.array_sort(F.collect_list("seq")).cast("array<string>"), ",").alias("roots"))


@query("hie14_leaves", f"{ELEMENTS_SQL} SELECT screen, seq FROM elements e WHERE NOT EXISTS (SELECT 1 FROM elements c WHERE c.screen = e.screen AND c.parent = e.seq)")
def hie14(spark, d):
    el = elements(spark, d).select("screen", "seq", "parent")
    return el.select("screen", "seq").join(el.select("screen", F.col("parent").alias("seq")), ["screen", "seq"], "left_anti")


@query("hie15_container_links", f"{ELEMENTS_SQL} SELECT b.screen, b.seq AS parent, a.seq AS child FROM elements a JOIN elements b ON a.screen = b.screen AND a.seq <> b.seq AND b.part % 3 = 0 AND 100 * {INTER_SQL} >= 75 * a.w * a.h")
def hie15(spark, d):
    el = elements(spark, d).withColumn("klass", F.when(F.col("part") % 3 == 0, "Window").otherwise("Text"))
    return hierarchy.container_links(el, KEYS)


@query("tag10_truncated", "SELECT conv_id, turn, CASE WHEN length(text) <= 50 THEN text ELSE left(text, 20) || '...' || right(text, 15) END AS text FROM conversations")
def tag10(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", truncate(F.col("text")).alias("text"))
