"""Detection and text metrics over ground truth and predictions (long tables with seq, box, label, text, score)."""

from __future__ import annotations

import warnings

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, overlapping
from ..functions.text import normalize
from .dedupe import _written
from .filters import _ious, edges
from .grouped import per_group


def clamped(df: DataFrame, width: int, height: int, most: int = 0) -> DataFrame:
    """Boxes cut to the page, scaled so that its longer side is at most ``most`` (0: as it is) and rounded half to even;
    empty ones go."""
    scale = most / max(width, height) if most and max(width, height) > most else 1.0
    x1, y1 = F.greatest(F.lit(0.0), F.least(F.col("x"), F.lit(float(width)))), F.greatest(F.lit(0.0), F.least(F.col("y"), F.lit(float(height))))
    x2, y2 = F.greatest(F.lit(0.0), F.least(F.col("x") + F.col("w"), F.lit(float(width)))), F.greatest(F.lit(0.0), F.least(F.col("y") + F.col("h"), F.lit(float(height))))
    r = lambda c: F.rint(c * scale).cast("long")
    out = df.withColumns({"_x": r(x1), "_y": r(y1), "_w": r(x2 - x1), "_h": r(y2 - y1)}).where("_w > 0 AND _h > 0")
    return out.drop("x", "y", "w", "h").withColumnsRenamed({f"_{c}": c for c in "xywh"})


def page_cells(gt: DataFrame, pred: DataFrame, keys: list[str], width: int, height: int, most: int = 0) -> DataFrame:
    """keys, inter, n_gt, n_both pixel counts: on the grid of a sample's own box edges, which equals the count of pixels."""
    both = clamped(gt, width, height, most).select(*keys, *"xywh", F.lit(1).alias("g")).union(clamped(pred, width, height, most).select(*keys, *"xywh", F.lit(0).alias("g")))

    def kernel(rows):
        b = edges(rows).astype(int)
        g = np.array([r["g"] for r in rows], bool)
        xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
        area = np.diff(xs)[:, None] * np.diff(ys)[None, :]
        seen = [np.zeros(area.shape, bool), np.zeros(area.shape, bool)]
        at = np.stack([np.searchsorted(xs, b[:, 0]), np.searchsorted(ys, b[:, 1]), np.searchsorted(xs, b[:, 2]), np.searchsorted(ys, b[:, 3])], axis=1)
        for (x1, y1, x2, y2), own in zip(at.tolist(), g.tolist(), strict=True):
            seen[own][x1:x2, y1:y2] = True
        return [{"inter": int(area[seen[0] & seen[1]].sum()), "n_gt": int(area[seen[1]].sum()), "n_union": int(area[seen[0] | seen[1]].sum())}]

    return per_group(both, keys, ["g"], kernel, "inter bigint, n_gt bigint, n_union bigint")


def label_cells(gt: DataFrame, pred: DataFrame, keys: list[str], width: int, height: int, most: int = 0, compat: bool = False) -> DataFrame:
    """keys, match, n_union: a pixel has the label of the smallest box on it (the first of equals); those agree.

    ``compat`` compares labels by the number of their first appearance on each side instead.
    """
    cols = lambda d, g: clamped(d.where(F.col("label") != ""), width, height, most).select(*keys, "seq", *"xywh", "label", F.lit(g).alias("g"))
    both = cols(gt, 1).union(cols(pred, 0))

    def kernel(rows):
        b = edges(rows).astype(int)
        xs, ys = np.unique(b[:, [0, 2]]), np.unique(b[:, [1, 3]])
        area = np.diff(xs)[:, None] * np.diff(ys)[None, :]
        maps, names = [np.full(area.shape, -1), np.full(area.shape, -1)], ({}, {})
        shared: dict = {}
        sides: list[list] = [[], []]
        for i, r in enumerate(rows):
            ids = names[r["g"]] if compat else shared
            sides[r["g"]].append((r["w"] * r["h"], i, ids.setdefault(r["label"], len(ids))))
        for g, side in enumerate(sides):
            for _, i, label in sorted(side, key=lambda x: (-x[0], -x[1])):  # the smallest and first is painted last
                maps[g][np.searchsorted(xs, b[i, 0]) : np.searchsorted(xs, b[i, 2]), np.searchsorted(ys, b[i, 1]) : np.searchsorted(ys, b[i, 3])] = label
        return [{"match": int(area[(maps[0] == maps[1]) & (maps[0] >= 0)].sum()), "n_union": int(area[(maps[0] >= 0) | (maps[1] >= 0)].sum())}]

    return per_group(both, keys, ["seq"], kernel, "match bigint, n_union bigint")


#: Fixed value: up to so many pairs of boxes are compared one by one.
FEW = 256


def greedy(rows: list[dict], threshold: float) -> list[tuple[dict, bool]]:
    """Predictions by falling score (null: 1), each with whether it takes the free truth of its best overlap, if that is
    ``threshold`` or more; the first of equals."""
    truth, preds = [r for r in rows if r["g"]], [r for r in rows if not r["g"]]
    ranked = sorted(preds, key=lambda r: -(1.0 if r["score"] is None else r["score"]))
    if len(truth) * len(preds) <= FEW and not any(r[c] is None for r in rows for c in "xywh"):
        return _few(truth, ranked, threshold)
    boxes, free, out = edges(truth), np.ones(len(truth), bool), []
    for p in ranked:
        hit = False
        if free.any():
            v = np.where(free, _ious(edges([p])[0], boxes), 0)
            best = int(np.argmax(v))
            hit = bool(v[best] > 0 and v[best] >= threshold)
            free[best] = free[best] and not hit
        out.append((p, hit))
    return out


def _few(truth: list[dict], ranked: list[dict], threshold: float) -> list[tuple[dict, bool]]:
    """As ``greedy``, without arrays, which cost more than they save on a few boxes."""
    free = [(t["x"], t["y"], t["x"] + t["w"], t["y"] + t["h"]) for t in truth]
    out = []
    for p in ranked:
        x1, y1 = p["x"], p["y"]
        x2, y2 = x1 + p["w"], y1 + p["h"]
        best, most = None, 0
        for k, (a1, b1, a2, b2) in enumerate(free):
            w, h = min(x2, a2) - max(x1, a1), min(y2, b2) - max(y1, b1)
            if w > 0 and h > 0 and (union := (x2 - x1) * (y2 - y1) + (a2 - a1) * (b2 - b1) - w * h) > 0 and w * h / union > most:
                best, most = k, w * h / union
        hit = best is not None and most >= threshold
        if hit:
            del free[best]
        out.append((p, hit))
    return out


def matches(gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float = 0.5, by_label: bool = True) -> DataFrame:
    """keys, label, seq, score, tp: every prediction with whether it found a truth of its sample (and label)."""
    side = lambda d, g: d.select(*keys, "seq", *[F.col(c).cast("double").alias(c) for c in "xywh"], (F.col("label") if by_label else F.lit("_all")).alias("label"), (F.col("score").cast("double") if g == 0 else F.lit(None).cast("double")).alias("score"), F.lit(g).alias("g"))
    both = side(gt, 1).union(side(pred, 0))
    both = both.where(F.col("label") != "") if by_label else both
    kernel = lambda rows: [{"seq": p["seq"], "score": 1.0 if p["score"] is None else p["score"], "tp": hit} for p, hit in greedy(rows, threshold)]
    return per_group(both, [*keys, "label"], ["seq"], kernel, "seq bigint, score double, tp boolean")


def average_precision(pairs: DataFrame, totals: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """by, n_gt, ap: of (by, score, tp) against truths counted in ``totals`` (by, n_gt), by the envelope of precision.

    Equal scores are taken in ``order``. Without truths 1, with truths and no predictions 0. Predictions are dealt out by
    ranges of (by, falling score, order): a range counts its own, and sums and maxima of a label's other ranges, a row
    each, are added. So no task holds a whole label. Null is a label like others.
    """
    slim = _written(pairs.select(*by, "score", *order, "tp"), "pairs")
    ranged = _written(slim.repartitionByRange(*by, F.desc("score"), *order).withColumn("_part", F.spark_partition_id()), "ranked")
    key = ["_part", *by]
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ranged.groupBy(*key).agg(F.count("*").alias("_n"), F.count_if("tp").alias("_t"))
    parts = parts.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)], *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("_n", "_t")])
    meets = lambda: [F.col("_part") == F.col("_p"), *[F.col(c).eqNullSafe(F.col(f"_b{k}")) for k, c in enumerate(by)]]
    ranked = Window.partitionBy(*key).orderBy(F.desc("score"), *order)
    run = ranged.withColumns({"_rn": F.row_number().over(ranked), "_tps": F.sum(F.col("tp").cast("long")).over(ranked.rowsBetween(Window.unboundedPreceding, 0))}).where("tp")
    # The envelope at a true positive is the best precision of those from it on.
    run = _written(run.join(F.broadcast(parts), meets()).select(*key, (F.col("_n") + F.col("_rn")).alias("_rn"), ((F.col("_t") + F.col("_tps")) / (F.col("_n") + F.col("_rn"))).alias("_v")), "precisions")
    after = Window.partitionBy(*[f"_b{k}" for k in range(len(by))]).orderBy(F.desc("_p")).rowsBetween(Window.unboundedPreceding, -1)
    best = run.groupBy(*key).agg(F.max("_v").alias("_v")).select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_b{k}") for k, c in enumerate(by)], F.col("_v").alias("_best"))
    best = best.withColumn("_later", F.max("_best").over(after)).drop("_best")
    down = Window.partitionBy(*key).orderBy(F.desc("_rn")).rowsBetween(Window.unboundedPreceding, 0)
    env = run.withColumn("_env", F.max("_v").over(down)).join(F.broadcast(best), meets())
    none = lambda kind: F.lit(None).cast(kind)
    area = env.groupBy(*by).agg(none("bigint").alias("n_gt"), F.sum(F.greatest("_env", "_later")).alias("area"))
    had = slim.select(*by).distinct().select(*by, none("bigint").alias("n_gt"), none("double").alias("area"))
    all_ = totals.select(*by, "n_gt", none("double").alias("area")).union(had).union(area).groupBy(*by).agg(F.max("n_gt").alias("n_gt"), F.max("area").alias("area"))
    n = F.coalesce("n_gt", F.lit(0))
    return all_.select(*by, n.alias("n_gt"), F.when(n == 0, 1.0).otherwise(F.coalesce("area", F.lit(0.0)) / n).alias("ap"))


def recall(gt: DataFrame, pred: DataFrame, keys: list[str], threshold: float = 0.5, by_label: bool = True) -> DataFrame:
    """keys, n_gt, tp by sample with truths; the data set's recall is sum(tp) / sum(n_gt)."""
    truths = (gt.where(F.col("label") != "") if by_label else gt).groupBy(*keys).agg(F.count("*").alias("n_gt"))
    found = matches(gt, pred, keys, threshold, by_label).where("tp").groupBy(*keys).agg(F.count("*").alias("tp"))
    return truths.join(found, keys, "left").select(*keys, "n_gt", F.coalesce("tp", F.lit(0)).alias("tp"))


def assignment(cost: np.ndarray) -> np.ndarray:
    """The column of each row in a cheapest assignment of a square matrix, by shortest augmenting paths."""
    n = len(cost)
    u, v = np.zeros(n), np.zeros(n + 1)
    row_of = np.full(n + 1, -1)
    for i in range(n):
        row_of[n], j = i, n
        dist, back, done = np.full(n, np.inf), np.full(n, n), np.zeros(n + 1, bool)
        while row_of[j] >= 0:
            done[j] = True
            r = row_of[j]
            open_ = np.flatnonzero(~done[:n])
            step = cost[r, open_] - u[r] - v[open_]
            closer = step < dist[open_]
            dist[open_[closer]], back[open_[closer]] = step[closer], j
            nearest = open_[np.argmin(dist[open_])]
            delta = dist[nearest]
            at = np.flatnonzero(done)
            u[row_of[at]] += delta
            v[at] -= delta
            dist[open_] -= delta
            j = nearest
        while j != n:
            row_of[j], j = row_of[back[j]], back[j]
    out = np.empty(n, int)
    out[row_of[:n]] = np.arange(n)
    return out


def distance(a: Column, b: Column) -> Column:
    """Edit distance by code points over the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).otherwise(F.lit(0.0))


def edit_distances(gt: DataFrame, pred: DataFrame, keys: list[str], gate: float = 0.0) -> DataFrame:
    """keys, n_gt, n_pred, cost: the cheapest assignment of a sample's predicted texts to its true ones.

    A truth without a prediction costs 1, a spare prediction nothing, a pair whose boxes overlap by less than ``gate`` 1.
    Samples without texts on either side have no row. Distances are native; only the assignment is made row by row.
    """
    t = lambda d, p: d.where(F.trim("text") != "").select(*keys, F.col("seq").alias(f"{p}seq"), normalize(F.col("text")).alias(f"{p}text"), *[F.col(c).cast("double").alias(p + c) for c in "xywh"])
    a, b = t(gt, "a_"), t(pred, "b_")
    from ..functions.geometry import iou

    cost = distance(F.col("a_text"), F.col("b_text"))
    cost = F.when(iou(Box.of("a_"), Box.of("b_")) < gate, 1.0).otherwise(cost) if gate > 0 else cost
    pairs = a.join(b, keys).select(*keys, "a_seq", "b_seq", cost.alias("cost"))

    def kernel(rows):
        ai = {s: k for k, s in enumerate(sorted({r["a_seq"] for r in rows}))}
        bi = {s: k for k, s in enumerate(sorted({r["b_seq"] for r in rows}))}
        n = max(len(ai), len(bi))
        m = np.ones((n, n))
        for r in rows:
            m[ai[r["a_seq"]], bi[r["b_seq"]]] = r["cost"]
        chosen = assignment(m)
        total = float(m[np.arange(len(ai)), chosen[: len(ai)]].sum())
        return [{"n_gt": len(ai), "n_pred": len(bi), "cost": total}]

    return per_group(pairs, keys, ["a_seq", "b_seq"], kernel, "n_gt bigint, n_pred bigint, cost double")


def summary(long: DataFrame, model: str = "model", metric: str = "metric", value: str = "value") -> DataFrame:
    """A row for each model, a column for each metric by name, with three decimals; blank for null."""
    names = sorted(r[0] for r in long.select(metric).distinct().collect())  # the few names of metrics
    return long.groupBy(model).pivot(metric, names).agg(F.coalesce(F.format_string("%.3f", F.first(value, ignorenulls=True)), F.lit("")))


__all__ = ["clamped", "page_cells", "label_cells", "matches", "average_precision", "recall", "assignment", "edit_distances", "summary", "overlapping"]


#: Each measure and the names that it may be asked for by.
ALIASES = {
    "page_iou": ("page_iou",),
    "page_recall": ("page_iou_recall", "pageiou_recall", "page_iou_rec"),
    "label_page_iou": ("label_page_iou", "labelawarepageiou"),
    "map": ("map", "map_50", "map50"),
    "recall_label": ("recall", "recall_label", "recall_labelaware"),
    "recall_any": ("recall_agnostic", "recall_nolabel", "recall_any"),
    "ned": ("ned", "normalized_edit_distance"),
}


def measure_of(name: Column) -> Column:
    """The measure that a name asks for; null if there is none."""
    out = F.lit(None).cast("string")
    for measure, names in ALIASES.items():
        out = F.when(name.isin(*names), F.lit(measure)).otherwise(out)
    return out


def measures_of(names: list[str]) -> list[str]:
    """The measures that names ask for, each once in order; names of none are warned of and skipped."""
    known = {n: measure for measure, ns in ALIASES.items() for n in ns}
    for n in names:
        if n not in known:
            warnings.warn(f"no measure is named {n!r}", stacklevel=2)
    return list(dict.fromkeys(known[n] for n in names if n in known))
