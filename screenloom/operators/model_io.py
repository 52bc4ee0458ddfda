"""Model answers: tolerant reading, predictors, prompts and scores."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from ..functions.text import shorten, strip
from ..schema import CLASSES, QUALITY

SCALE = 1000.0
#: Keys of a box in a model's answer, first match first, and the places of left, top, right, bottom in its list.
BOX_KEYS = (("bbox_ltrb", (0, 1, 2, 3)), ("bbox_tlbr", (1, 0, 3, 2)), ("bbox", (0, 1, 2, 3)), ("bbox_xywh", None))
ELEMENTS = "array<struct<label:string,text:string,score:double,x:double,y:double,w:double,h:double>>"


def first_object(c: Column) -> Column:
    """The text from the first { to the last }, null if there is none."""
    found = F.regexp_extract(F.coalesce(c, F.lit("")), r"(?s)\{.*\}", 0)
    return F.when(found != "", found)


def answer_object(c: Column) -> Column:
    """That text as a VARIANT, null unless it is a JSON object."""
    v = F.try_parse_json(first_object(c))
    return F.when(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), v)


def balanced_object(text: str | None) -> dict | None:
    """The first object of an answer whose braces balance, else from the first { to the last }; null if it isn't one.

    Fences around a code block go first.
    """
    s = (text or "").strip()
    s = re.sub(r"```(?:json)?", "", s).strip() if s.startswith("```") else s
    start, depth, end = s.find("{"), 0, -1
    for m in re.finditer(r"[{}]", s[start:] if start >= 0 else ""):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            end = start + m.end()
            break
    if end < 0 and start >= 0:
        end = s.rfind("}") + 1
    try:
        got = json.loads(s[start:end]) if 0 <= start < end else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


SCORES = ("coverage_score", "false_positive_score", "duplication_score", "localization_score", "overall_quality")


def number(v, default: float = 0.0) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return default


def quality_scores(df: DataFrame, key: str, answer: str, least: float = QUALITY) -> DataFrame:
    """key, short_summary, the five scores and accepted: overall_quality of ``least`` or more. Unreadable answers score 0."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            objs = [balanced_object(a) or {} for a in pdf[answer]]
            yield pd.DataFrame({key: pdf[key], "short_summary": [str(o.get("short_summary") or "") for o in objs], **{s: [number(o.get(s, 0.0)) for o in objs] for s in SCORES}})

    out = df.select(key, answer).mapInPandas(run, f"{key} {kind}, short_summary string, " + ", ".join(f"{s} double" for s in SCORES))
    return out.withColumn("accepted", F.col("overall_quality") >= least)


def plain_label(v) -> str | None:
    if isinstance(v, (list, tuple)):
        return next((s for x in v if x is not None and (s := str(x).strip())), None)
    return None if v is None else str(v)


def plain_text(v) -> str | None:
    if isinstance(v, (list, tuple)):
        parts = [x.strip() if isinstance(x, str) else str(x) for x in v if x is not None and (not isinstance(x, str) or x.strip())]
        return " ".join(parts) if parts else None
    return None if v is None else str(v)


def plain_score(v) -> float | None:
    while isinstance(v, (list, tuple)) and v:
        v = v[0]
    try:
        return None if v is None else float(v)
    except (TypeError, ValueError):
        return None


def read_elements(answer: str | None, width: float, height: float, tlbr_first: bool = False) -> list[dict]:
    """Elements of the list from the first [ to the last ] with boxes of 0..1000 scaled to the page.

    Labels, texts and scores may be lists. Objects without a box go; anything else that can't be read empties the whole
    answer.
    """
    s = answer or ""
    try:
        items = json.loads(s[s.index("[") : s.rindex("]") + 1])
        out = []
        order = [BOX_KEYS[1], BOX_KEYS[0], *BOX_KEYS[2:]] if tlbr_first else BOX_KEYS
        for o in items if isinstance(items, list) else []:
            pick = lambda *names: next((o[k] for k in names if o.get(k)), None)  # noqa: B023, E731
            found = next(((o[k], at) for k, at in order if k in o), None)
            if found is None:
                continue
            values, at = found
            a, b, c, d = map(float, values)
            l, t, r, m = (a, b, a + c, b + d) if at is None else ((a, b, c, d)[i] for i in at)  # noqa: E741
            xs, ys = (sorted(max(0.0, min(v, SCALE)) / SCALE * max(size, 0) for v in pair) for pair, size in (((l, r), width), ((t, m), height)))
            out.append({"label": plain_label(pick("label", "type", "tag")), "text": plain_text(pick("text", "inner_text", "own_text")), "score": plain_score(pick("score", "confidence")), "x": xs[0], "y": ys[0], "w": xs[1] - xs[0], "h": ys[1] - ys[0]})
        return out
    except (ValueError, TypeError, AttributeError, KeyError):
        return []


def answers_to_elements(df: DataFrame, key: str, answer: str, width: int, height: int, tlbr_first: bool = False) -> DataFrame:
    """A row for each element of each answer: key, seq and the element's columns."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            rows = [{key: k, "seq": i, **e} for k, a in zip(pdf[key], pdf[answer], strict=True) for i, e in enumerate(read_elements(a, width, height, tlbr_first))]
            yield pd.DataFrame({c: pd.Series([r[c] for r in rows], dtype=object) for c in (key, "seq", "label", "text", "score", "x", "y", "w", "h")})

    return df.select(key, answer).mapInPandas(run, f"{key} {kind}, seq bigint, label string, text string, score double, x double, y double, w double, h double")


class Predictor:
    """A model: open() once a task, predict() on batches of rows, close() at the end, also after an error."""

    schema = "prediction string"

    def open(self) -> None: ...

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        raise NotImplementedError

    def close(self) -> None: ...


class CallablePredictor(Predictor):
    """A plain function of a row (dict) as a predictor of one column."""

    def __init__(self, function: Callable[[dict], object], schema: str = "prediction string"):
        self.function, self.schema, self.column = function, schema, schema.split()[0]

    def predict(self, batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({self.column: [self.function(r) for r in batch.to_dict("records")]})


def predicted(df: DataFrame, keys: list[str], predictor: Predictor) -> DataFrame:
    """keys with the predictor's columns and error: a batch that fails has null columns and its error, and the rest goes on."""
    fields = _parse_datatype_string(predictor.schema).fields
    schema = ", ".join([f"{k} {df.schema[k].dataType.simpleString()}" for k in keys] + [f"{f.name} {f.dataType.simpleString()}" for f in fields] + ["error string"])
    names = [f.name for f in fields]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predictor.open()
        try:
            for pdf in batches:
                try:
                    got = predictor.predict(pdf).reset_index(drop=True)
                    if len(got) != len(pdf):
                        raise ValueError(f"{len(got)} predictions for {len(pdf)} rows")
                    got["error"] = None
                except Exception as e:  # a model's error is a value of its rows
                    got = pd.DataFrame({n: [None] * len(pdf) for n in names} | {"error": [repr(e)] * len(pdf)})
                yield pd.concat([pdf[keys].reset_index(drop=True), got], axis=1)
        finally:
            predictor.close()

    return df.mapInPandas(run, schema)


def crop_of(x: Column, y: Column, w: Column, h: Column, width: Column, height: Column, scale: float = 1.0) -> Column:
    """The pixels of a box in an image: sides times ``scale``, rounded half to even; a corner left of or above the image moves
    to its edge without a change of size, and what is beyond the far edges is cut. Null if nothing is left."""
    x1, y1, w1, h1 = (F.rint(c * scale).cast("long") for c in (x, y, w, h))
    left, top = F.greatest(x1, F.lit(0)), F.greatest(y1, F.lit(0))
    right, bottom = F.least(left + w1, width), F.least(top + h1, height)
    return F.when((right > left) & (bottom > top), F.struct(left.alias("left"), top.alias("top"), (right - left).alias("width"), (bottom - top).alias("height")))


def element_texts(elements: DataFrame, keys: list[str], index: str, predictor: Predictor, scale: float = 1.0) -> DataFrame:
    """keys, element_index and text that a recogniser reads in each element's crop, less what is blank.

    ``elements`` has x, y, w, h, image_width, image_height and what the predictor wants (an image's path or bytes); it gets
    them with left, top, width and height of the crop, and gives the column text. Crops that hold no pixel aren't sent; a batch
    that fails gives no texts.
    """
    sides = ("left", "top", "width", "height")
    crop = crop_of(*(F.col(c) for c in ("x", "y", "w", "h", "image_width", "image_height")), scale)
    asked = elements.drop(*sides).withColumn("_crop", crop).where("_crop IS NOT NULL").withColumns({c: F.col(f"_crop.{c}") for c in sides}).drop("_crop")
    read = predicted(asked, [*keys, index], predictor).withColumn("text", strip(F.col("text")))
    return read.where("text <> ''").select(*keys, F.col(index).alias("element_index"), "text")


def snippet(tag: Column, attrs: Column, text: Column) -> Column:
    """An element as a line of HTML: known attributes up to 120 characters, its text up to 200."""
    bits = [F.when(F.try_element_at(attrs, F.lit(a)) != "", F.concat(F.lit(f' {a}="'), shorten(F.try_element_at(attrs, F.lit(a)), 120, 117, "...", 0), F.lit('"'))).otherwise(F.lit("")) for a in ("id", "class", "role", "type", "aria-label", "aria-hidden", "href", "value", "name", "placeholder")]
    name = F.lower(F.coalesce(F.nullif(tag, F.lit("")), F.lit("div")))
    return F.concat(F.lit("<"), name, *bits, F.lit(">"), shorten(F.trim(F.coalesce(text, F.lit(""))), 200, 170, " ... ", 20), F.lit("</"), name, F.lit(">"))


def prompt(html: Column) -> Column:
    """The question for a predictor: the allowed labels, then the snippet cut to about 1500 characters."""
    return F.concat(F.lit("Allowed labels:\n- " + "\n- ".join(CLASSES) + "\n\nElement:\n"), shorten(F.trim(F.coalesce(html, F.lit(""))), 1500, 1400, " … ", 90), F.lit("\n\nAnswer with one JSON object: label and interactable."))


def compact_json(row: Column) -> Column:
    """A struct as compact JSON without null fields."""
    return F.to_json(row)


def crop(x: Column, y: Column, w: Column, h: Column, scale: Column, width, height, pad: int = 5) -> dict[str, Column]:
    """The padded crop of a box in image pixels, cut to the image, and whether it is worth a look (2 pixels, aspect 199)."""
    wide, high = (F.lit(v) if isinstance(v, int) else v for v in (width, height))
    r = lambda c: F.rint(c * scale).cast("int")
    cx, cy = F.greatest(F.lit(0), r(x) - pad), F.greatest(F.lit(0), r(y) - pad)
    cw, ch = F.least(wide - cx, r(w) + 2 * pad), F.least(high - cy, r(h) + 2 * pad)
    small = F.least(cw, ch)
    return {"crop_x": cx, "crop_y": cy, "crop_w": cw, "crop_h": ch, "usable": (small >= 2) & (F.greatest(cw, ch) <= 199 * small)}


def relabel(df: DataFrame, answers: DataFrame, keys: list[str]) -> DataFrame:
    """Elements with vlm_label and vlm_interactable from the answers (keys, label, interactable) that belong to them."""
    return df.drop("vlm_label", "vlm_interactable").join(answers.select(*keys, F.col("label").alias("vlm_label"), F.col("interactable").alias("vlm_interactable")), keys, "left")
