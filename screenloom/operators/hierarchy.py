"""Parents from geometry, depth, own text, reading order and markup of screens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.geometry import Box, containment, nearly_equal, overlapping
from ..functions.text import own_text
from ..schema import CONTAINERS, LEAF_ONLY, VIEWPORT_H, VIEWPORT_W
from .grouped import per_group


#: Fixed value: nodes of markup that are held at a time, or one markup's.
NODES_AT_ONCE = 10000


def parents(df: DataFrame, keys: list[str], least: float = 0.85, semantic: bool = False, strict: bool = False) -> DataFrame:
    """Each row of ``df`` (keys, seq, x, y, w, h, klass) with parent: the seq of the smallest box around it, or null.

    A parent is no smaller, not nearly the same box, holds at least ``least`` of the row, and with ``semantic`` is of no
    leaf class; of equal areas the lowest seq. Equal boxes apart by over 2 pixels may be each other's parents; ``strict``
    asks for a larger area or a lower seq, which leaves no cycles. Rows without area have none.
    """
    a, b = Box.of("a_"), Box.of("b_")
    slim = df.select(*keys, "seq", *"xywh", "klass")
    pairs = overlapping(slim, slim, keys).where((F.col("a_seq") != F.col("b_seq")) & (b.area >= a.area) & ~nearly_equal("a_", "b_") & (containment(a, b) >= least))
    if semantic:
        pairs = pairs.where(~F.coalesce(F.col("b_klass").isin(*LEAF_ONLY), F.lit(False)))
    if strict:
        pairs = pairs.where((b.area > a.area) | (F.col("b_seq") < F.col("a_seq")))
    best = pairs.groupBy(*keys, F.col("a_seq").alias("seq")).agg(F.min(F.struct(b.area.alias("area"), F.col("b_seq").alias("parent"))).alias("_best"))
    return df.drop("parent").join(best, [*keys, "seq"], "left").withColumn("parent", F.col("_best.parent")).drop("_best")


def depths(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, depth: steps up to a root, or until a row comes back."""

    def kernel(rows):
        up = {r["seq"]: r["parent"] for r in rows}
        out = []
        for r in rows:
            seen, at, n = {r["seq"]}, r["parent"], 0
            while at is not None:
                n += 1
                if at in seen:
                    break
                seen.add(at)
                at = up.get(at)
            out.append({"seq": r["seq"], "depth": n})
        return out

    return per_group(df.select(*keys, "seq", "parent"), keys, ["seq"], kernel, "seq bigint, depth bigint")


def children(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, children: the rows that name it as parent, ascending."""
    return df.where(F.col("parent").isNotNull()).groupBy(*keys, F.col("parent").alias("seq")).agg(F.array_sort(F.collect_list(F.col("seq"))).alias("children"))


def container_links(df: DataFrame, keys: list[str], containers=CONTAINERS, least: float = 0.75) -> DataFrame:
    """keys, parent, child: every container that holds at least ``least`` of another row."""
    slim = df.select(*keys, "seq", *"xywh", "klass")
    inside = slim.where(F.col("klass").isin(*containers))
    return overlapping(slim, inside, keys).where((F.col("a_seq") != F.col("b_seq")) & (containment(Box.of("a_"), Box.of("b_")) >= least)).select(*keys, F.col("b_seq").alias("parent"), F.col("a_seq").alias("child"))


def own_texts(df: DataFrame, keys: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """keys, seq, own_text of rows (seq, parent, tag, inner_text), and the columns ``carry``, which saves a join with ``df``."""

    def kernel(rows):
        below: dict = {}
        for r in rows:
            below.setdefault(r["parent"], []).append((r["inner_text"], r["tag"]))
        return [{"seq": r["seq"], "own_text": own_text(r["inner_text"], below.get(r["seq"], [])), **{c: r[c] for c in carry}} for r in rows]

    needed = dict.fromkeys([*keys, "seq", "parent", "tag", "inner_text", *carry])
    schema = "".join(f", {c} {df.schema[c].dataType.simpleString()}" for c in carry)
    return per_group(df.select(*needed), keys, ["seq"], kernel, "seq bigint, own_text string" + schema)


def reading_order(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, reading_order: depth first, with roots and siblings by (y, x, h, w, seq); rows in cycles come last.

    Parents that are missing or the row itself make it a root.
    """

    def kernel(rows):
        by_seq = {r["seq"]: r for r in rows}
        spatial = lambda r: (r["y"], r["x"], r["h"], r["w"], r["seq"])
        below: dict = {}
        for r in sorted(rows, key=spatial, reverse=True):
            up = r["parent"]
            below.setdefault(up if up in by_seq and up != r["seq"] else None, []).append(r)
        order, seen, todo = [], set(), list(below.get(None, []))
        while todo:
            r = todo.pop()
            if r["seq"] not in seen:
                seen.add(r["seq"])
                order.append(r["seq"])
                todo += below.get(r["seq"], [])
        order += [r["seq"] for r in sorted(rows, key=spatial) if r["seq"] not in seen]
        return [{"seq": s, "reading_order": k} for k, s in enumerate(order)]

    return per_group(df.select(*keys, "seq", "parent", *"xywh"), keys, ["seq"], kernel, "seq bigint, reading_order bigint")


def serialize(df: DataFrame, keys: list[str], width: int = VIEWPORT_W, height: int = VIEWPORT_H) -> DataFrame:
    """keys, markup of rows (seq, parent, x, y, w, h, label, type, tag, text). Tags and locations are made natively."""
    x, y, w, h = (F.col(c) for c in "xywh")
    ready = df.select(*keys, F.col("seq").alias("idx"), "parent", "x", "y", markup.location(x, y, x + w, y + h, width, height).alias("head"), markup.tag_name(F.col("label"), F.col("type"), F.col("tag")).alias("tag"), F.trim(F.coalesce("text", F.lit(""))).alias("text"))
    return per_group(ready, keys, ["idx"], lambda rows: [{"markup": markup.write(rows)}], "markup string")


def parse(df: DataFrame, key: str, column: str = "markup", strict: bool = False, width: int = VIEWPORT_W, height: int = VIEWPORT_H) -> DataFrame:
    """A row for each node of the markup: key, node_id, parent_id, depth, tag, l, t, r, b, text. No shuffle; some nodes are
    held at a time, whatever the number of markups in a batch."""
    import pandas as pd
    from pyspark.sql.types import StructType, _parse_datatype_string

    from ..schema import NODES

    schema = StructType([df.schema[key], *_parse_datatype_string(NODES).fields])
    names = schema.names

    def frame(made: list[list]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series(v, dtype=object) for c, v in zip(names, made, strict=True)})

    def run(batches):
        for pdf in batches:
            made: list[list] = [[] for _ in names]
            for k, m in zip(pdf[key], pdf[column], strict=True):
                nodes = markup.read_strict(m, width, height) if strict else markup.read(m)
                made[0] += [k] * len(nodes)
                for values, c in zip(made[1:], names[1:], strict=True):
                    values += [x[c] for x in nodes]
                if len(made[0]) >= NODES_AT_ONCE:
                    yield frame(made)
                    made = [[] for _ in names]
            if made[0]:
                yield frame(made)

    return df.select(key, column).mapInPandas(run, schema)
