"""Label matching, normalisation and schema mapping as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import CLASSES, EIGHT_OF, EIGHT_REPRESENTATIVE, LABEL_ALIASES, OCR_LABELS, TWO, TWO_REPRESENTATIVE, TWO_TEXT, TYPE_KEYWORDS

_LOWER = {c.lower(): c for c in CLASSES}


def lookup(c: Column, table: dict[str, str]) -> Column:
    """The value of a small fixed table, null where there is none: a literal map, so no join."""
    return F.try_element_at(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))]), c)


def match_label(raw: Column) -> Column:
    """The class of that name whatever its case; null for blank, unknown and other names."""
    return lookup(F.lower(F.trim(raw)), _LOWER)


def class_from_type(type_: Column) -> Column:
    low = F.lower(F.trim(type_))
    out = F.when(low.isin("", "unknown"), F.lit(None).cast("string"))
    found = lookup(low, _LOWER)
    out = out.when(found.isNotNull(), found)
    for word, name in TYPE_KEYWORDS:
        out = out.when(F.contains(low, F.lit(word)), name)
    return out


def export_class(label: Column, type_: Column) -> Column:
    """The label's class, else the type's, else Text."""
    return F.coalesce(match_label(label), class_from_type(type_), F.lit("Text"))


def class_id(name: Column) -> Column:
    return F.when(name.isNotNull(), F.array_position(F.array(*map(F.lit, CLASSES)), name).cast("int") - 1)


def normalize_label(raw: Column) -> Column:
    """By alias, then by name, then the first class whose name holds the label or is held by it.

    A label that is empty once signs are spaces, such as ``-``, is in every name and gives the first class.
    """
    plain = F.trim(raw)
    low = F.trim(F.regexp_replace(F.lower(plain), r"[\s\-_/]+", " "))
    names = F.array(*map(F.lit, CLASSES))
    near = F.filter(names, lambda c: F.contains(F.lower(c), low) | F.contains(low, F.lower(c)))
    return F.when(raw != "", F.coalesce(lookup(low, LABEL_ALIASES), lookup(F.lower(plain), _LOWER), F.try_element_at(near, F.lit(1))))


def as_boolean(v: Column) -> Column:
    """A text's truth: true, yes, y, 1 and t, or a number that isn't zero."""
    low = F.lower(F.trim(v))
    return F.coalesce(low.isin("true", "yes", "y", "1", "t") | (F.coalesce(low.try_cast("double"), F.lit(0.0)) != 0), F.lit(False))


def map_label(label: Column, schema: str) -> Column:
    """``label`` in the schema ``eight``, ``two`` or (any other name) the 55 classes; unknown labels pass through."""
    own = F.trim(label)
    if schema == "eight":
        out = F.coalesce(lookup(own, {c: name for name, members in EIGHT_OF.items() for c in members}), own)
    elif schema == "two":
        out = F.coalesce(F.when(F.lower(own).isin(*TWO), F.lower(own)), lookup(own, {c: "text" if c in TWO_TEXT else "icon" for c in CLASSES}), F.lower(own))
    else:
        out = F.coalesce(lookup(own, EIGHT_REPRESENTATIVE), lookup(F.lower(own), TWO_REPRESENTATIVE), own)
    return F.when(label == "", label).otherwise(out)


def ocr_label(label: Column) -> Column:
    return F.when(label != "", F.coalesce(lookup(label, OCR_LABELS), F.initcap(label)))
