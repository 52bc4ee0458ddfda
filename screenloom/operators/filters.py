"""Element filters: predicates, suppression of duplicates, hierarchy repair, wrapper pruning and text recovery."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import elements as E
from ..functions.geometry import Box, containment, overlapping, prefixed, viewport_share
from ..schema import CONTAINMENT, IOU, MAX_AREA, MIN_AREA, TEXT_TAGS, VIEWPORT_H, VIEWPORT_W
from .grouped import per_group

OWN_TEXT = 15
#: Fixed value: rows of a screen that are compared with all at a time.
BAND = 256


def passes(protected: Column, width: int = VIEWPORT_W, height: int = VIEWPORT_H, min_area: int = MIN_AREA, max_area: int = MAX_AREA) -> Column:
    """The row predicates: over a pixel wide and high, not tiny unless protected, not huge unless an image, at least a
    hundredth visible, no small svg path, not hidden. Sizes are areas. Null boxes don't pass."""
    box = Box.of()
    x, y, w, h = (F.col(c) for c in "xywh")
    area = w * h
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    touches = (x + w >= 0) & (y + h >= 0) & (x <= width) & (y <= height)
    ok = (w > 1) & (h > 1) & ((area >= min_area) | protected) & ((area <= max_area) | (low("type") == "image")) & touches
    ok = ok & (viewport_share(box, width, height) >= 0.01) & ~((low("tag") == "path") & (area < 400)) & (low("aria_hidden") != "true")
    return F.coalesce(ok, F.lit(False))


def _ious(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2], others[..., 2]) - np.maximum(box[0], others[..., 0])
    h = np.minimum(box[3], others[..., 3]) - np.maximum(box[1], others[..., 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0)
    union = (box[2] - box[0]) * (box[3] - box[1]) + (others[..., 2] - others[..., 0]) * (others[..., 3] - others[..., 1]) - inter
    return np.divide(inter, union, out=np.zeros(union.shape), where=union > 0)


def edges(rows: list[dict]) -> np.ndarray:
    return np.array([(r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"]) for r in rows], float).reshape(-1, 4)


def suppressed(rows: list[dict], threshold: float = IOU, same: float = 0.65) -> list[int]:
    """Places of the rows that stay, in order of falling area.

    A row meets the first kept one that overlaps it by more than ``threshold``, or by ``same`` of that if their classes
    agree. It goes, but for a protected row over an unprotected one at the full threshold: that one's place is taken.
    Null classes agree with none.
    """
    boxes = edges(rows)
    area = (boxes[:, 2] - boxes[:, 0]) * (boxes[:, 3] - boxes[:, 1])
    order = np.argsort(-area, kind="stable")
    ids: dict = {}
    kind = np.array([ids.setdefault((r["klass"] or "").lower(), len(ids)) for r in rows])[order]
    kind[kind == ids.get("", -1)] = -1
    boxes, flags = boxes[order], [bool(rows[i]["protected"]) for i in order.tolist()]
    # Pairs over a threshold, a band of rows against all at a time; few pairs are, and only those are gone through.
    before: dict[int, list] = {}
    for at in range(0, len(rows), BAND):
        one = boxes[at : at + BAND, None]
        v = _ious(np.moveaxis(one, -1, 0), boxes[None, : at + BAND])
        full = v > threshold
        alike = (kind[at : at + BAND, None] == kind[None, : at + BAND]) & (kind[at : at + BAND, None] >= 0)
        for i, j in zip(*(x.tolist() for x in np.nonzero(full | alike & (v > threshold * same))), strict=True):
            if j < i + at:
                before.setdefault(i + at, []).append((j, bool(full[i, j])))
    kept: dict[int, None] = {}
    for i in range(len(rows)):
        # Kept rows are in order of their places, so the first hit is the one of the lowest place.
        hit = next(((j, over) for j, over in before.get(i, ()) if j in kept), None)
        if hit:
            if not (hit[1] and flags[i] and not flags[hit[0]]):
                continue
            del kept[hit[0]]
        kept[i] = None
    return order[list(kept)].tolist() if kept else []


def suppress(df: DataFrame, keys: list[str], threshold: float = IOU) -> DataFrame:
    """keys, seq and rank of the rows that stay. Needs seq, x, y, w, h, protected, klass."""
    return per_group(df.select(*keys, "seq", *"xywh", "protected", "klass"), keys, ["seq"], lambda rows: [{"seq": rows[i]["seq"], "rank": k} for k, i in enumerate(suppressed(rows, threshold))], "seq bigint, rank bigint")


def orphan(row: dict, by_seq: dict, tolerance: int = 5, hops: int = 12) -> bool:
    """Whether the x-range common to the row and those of its next ``hops`` ancestors that are about as wide is empty."""
    low, high, up = row["x"], row["x"] + row["w"], by_seq.get(row["parent"])
    for _ in range(hops):
        if up is None:
            return False
        if up["w"] >= row["w"] - tolerance:
            low, high = max(low, up["x"]), min(high, up["x"] + up["w"])
            if high <= low:
                return True
        up = by_seq.get(up["parent"])
    return False


def orphans(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and seq of positional orphans."""

    def kernel(rows):
        by_seq = {r["seq"]: r for r in rows}
        return [{"seq": r["seq"]} for r in rows if orphan(r, by_seq)]

    return per_group(df.select(*keys, "seq", "parent", "x", "w"), keys, ["seq"], kernel, "seq bigint")


def nearest_kept(parent: dict, kept: set, seq):
    """The nearest ancestor of ``seq`` in ``kept``, null if there is none or the chain comes back."""
    seen = set()
    up = parent.get(seq)
    while up is not None and up not in kept:
        if up in seen:
            return None
        seen.add(up)
        up = parent.get(up)
    return up


def remap(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, parent of the rows with ``kept``: the parent is the nearest kept ancestor."""

    def kernel(rows):
        parent, kept = {r["seq"]: r["parent"] for r in rows}, {r["seq"] for r in rows if r["kept"]}
        return [{"seq": r["seq"], "parent": nearest_kept(parent, kept, r["seq"])} for r in rows if r["kept"]]

    return per_group(df.select(*keys, "seq", "parent", "kept"), keys, ["seq"], kernel, "seq bigint, parent bigint")


def left_over(text: str | None, children: list[str | None]) -> str:
    own = (text or "").strip()
    for c in children:
        if c and c.strip():
            own = own.replace(c.strip(), "", 1)
    return own.strip()


def recovered(rows: list[dict], kept: set) -> list:
    """seq of dropped text elements with own text whose direct child is kept."""
    below: dict = {}
    for r in rows:
        if r["parent"] is not None:
            below.setdefault(r["parent"], []).append(r)
    return [r["seq"] for r in rows if r["seq"] not in kept and (r["tag"] or "").lower() in TEXT_TAGS and any(c["seq"] in kept for c in below.get(r["seq"], [])) and len(left_over(r["inner_text"], [c["inner_text"] for c in below[r["seq"]]])) >= OWN_TEXT]


def recover(df: DataFrame, keys: list[str]) -> DataFrame:
    return per_group(df.select(*keys, "seq", "parent", "tag", "inner_text", "kept"), keys, ["seq"], lambda rows: [{"seq": s} for s in recovered(rows, {r["seq"] for r in rows if r["kept"]})], "seq bigint")


def with_flags(df: DataFrame) -> DataFrame:
    """protected, klass and wrapper_like of elements (tag, role, type, label, attrs)."""
    label = F.col("label") if "label" in df.columns else F.lit(None).cast("string")
    return df.withColumns({
        "protected": E.is_protected(F.col("tag"), F.col("role"), F.col("type"), E.attribute(F.col("attrs"), "class"), E.attribute(F.col("attrs"), "onclick")),
        "klass": E.element_class(label, F.col("type")),
        "wrapper_like": E.is_wrapper(F.col("tag"), F.col("role"), F.col("type"), F.col("attrs"), F.lit(1)),
    })


def filter_elements(df: DataFrame, keys: list[str], threshold: float = IOU, **limits) -> DataFrame:
    """The whole filter: keys, seq, rank (place in the result) and parent (a seq) of the elements that stay.

    Predicates, then suppression, then parents are the nearest kept ancestors, then wrapper divs with a child go, then
    dropped text elements with own text and a kept child come back at the end. Needs seq, parent, box, tag, role, type,
    attrs, aria_hidden, inner_text. One shuffle, by ``keys``.
    """
    ready = with_flags(df)
    ready = ready.select(*keys, "seq", "parent", *"xywh", "tag", "inner_text", "protected", "klass", "wrapper_like", passes(F.col("protected"), **limits).alias("ok"))

    def kernel(rows):
        by_seq = {r["seq"]: r for r in rows}
        parent = {r["seq"]: r["parent"] for r in rows}
        some = [r for r in rows if r["ok"] and not orphan(r, by_seq)]
        some = [some[i] for i in suppressed(some, threshold)] if threshold < 1 else some
        kept = {r["seq"] for r in some}
        has_child = {nearest_kept(parent, kept, s) for s in kept}
        order = [r["seq"] for r in some if not (r["wrapper_like"] and r["seq"] in has_child)]
        order += recovered(rows, set(order))
        final = set(order)
        return [{"seq": s, "rank": k, "parent": nearest_kept(parent, final, s)} for k, s in enumerate(order)]

    return per_group(ready, keys, ["seq"], kernel, "seq bigint, rank bigint, parent bigint")


def leaves(df: DataFrame, keys: list[str], min_own: int = OWN_TEXT) -> DataFrame:
    """Rows of a hierarchy (seq, parent, inner_text, reading_order) that are leaves or have own text beside their children's."""

    def kernel(rows):
        below: dict = {}
        for r in rows:
            below.setdefault(r["parent"], []).append(r["inner_text"])
        out = [r for r in rows if r["seq"] not in below or len(left_over(r["inner_text"], below[r["seq"]])) >= min_own]
        out.sort(key=lambda r: (r["reading_order"] is None, r["reading_order"] or 0))
        return [{"seq": r["seq"], "place": k} for k, r in enumerate(out)]

    return per_group(df.select(*keys, "seq", "parent", "inner_text", "reading_order"), keys, ["seq"], kernel, "seq bigint, place bigint")


def redundant_parents(df: DataFrame, keys: list[str], threshold: float = CONTAINMENT) -> DataFrame:
    """keys and seq of rows that hold a row of their class by more than ``threshold``, unless only the holder is protected."""
    ready = df.select(*keys, "seq", *"xywh", "protected", "klass").where(F.col("klass").isNotNull())
    pairs = overlapping(ready, ready, keys).where((F.col("a_seq") != F.col("b_seq")) & (F.lower("a_klass") == F.lower("b_klass")) & (F.col("b_protected") | ~F.col("a_protected")))
    return pairs.where(containment(Box.of("b_"), Box.of("a_")) > threshold).select(*keys, F.col("a_seq").alias("seq")).distinct()


def impact(original: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """By type: original and kept counts, those removed, and removed ones that are protected."""
    stays = kept.select(*keys, "seq").withColumn("_k", F.lit(1))
    joined = original.join(stays, [*keys, "seq"], "left")
    gone = F.col("_k").isNull()
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return joined.groupBy(F.lower(F.coalesce("type", F.lit("unknown"))).alias("type")).agg(F.count("*").alias("n_original"), one(~gone).alias("n_kept"), one(gone).alias("n_removed"), one(gone & F.col("protected")).alias("n_protected_removed"))


def empty_labels(images: DataFrame, labels: DataFrame) -> DataFrame:
    """Images (split, stem) whose label text is missing or blank in its first 128 characters."""
    full = labels.where(F.substring("text", 1, 128).rlike(r"\S")).select("split", "stem").distinct()
    return images.join(full, ["split", "stem"], "left_anti")


__all__ = ["passes", "suppress", "orphans", "remap", "recover", "filter_elements", "leaves", "redundant_parents", "impact", "empty_labels", "with_flags", "prefixed"]
