"""Text normalisation, truncation and own-text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is left of a text counts as nothing if it is up to two characters in a row of these.
LEFTOVERS = ".,;:!?-–—•·"
LINK_SHARE = 0.3


def strip(c: Column) -> Column:
    """Without white space of any kind around; null stays."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), r"(?U)\s+", " ")


def truncate(c: Column, most: int = 50, head: int = 20, tail: int = 15) -> Column:
    short = (F.length(c) <= most) | (F.length(c) <= head + tail + 3)
    return F.when(short, c).otherwise(F.concat(F.substring(c, 1, head), F.lit("..."), F.right(c, F.lit(tail))))


def shorten(c: Column, most: int, head: int, middle: str, tail: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, head), F.lit(middle), F.right(c, F.lit(tail)))).otherwise(c)


def _plain(s: str) -> str:
    return " ".join(s.lower().split())


def _find(part: str, whole: str) -> tuple[int, int] | None:
    """Where ``part`` first stands in ``whole``, whatever the case. ASCII needs no pattern, whose making costs most."""
    if part.isascii() and whole.isascii():
        at = whole.lower().find(part.lower())
        return None if at < 0 else (at, at + len(part))
    m = re.search(re.escape(part), whole, re.I)
    return m and m.span()


def own_text(text: str | None, children: list[tuple[str | None, str | None]]) -> str:
    """What of ``text`` is not its children's (text, tag), in their order.

    Nothing where the children's texts joined by spaces are the text. A link's text that is under three tenths of the
    whole stays, as part of a sentence; other children's texts go, longest first, at their first place whatever the case.
    """
    whole = (text or "").strip()
    held = [(t.strip(), tag) for t, tag in children if t and t.strip()]
    if not whole or not held:
        return whole
    plain = _plain(whole)
    if plain == " ".join(_plain(t) for t, _ in held):
        return ""
    gone = []
    for t, tag in held:
        found = t if t in whole else None
        if found is None and (span := _find(_plain(t), whole)):
            found = whole[slice(*span)]
        if found is None or tag == "a" and _plain(t) != plain and len(_plain(t)) < LINK_SHARE * len(plain):
            continue
        gone.append(found)
    for t in sorted(gone, key=len, reverse=True):
        if span := _find(t, whole):
            whole = whole[: span[0]] + " " + whole[span[1] :]
    whole = " ".join(whole.split())
    return "" if len(whole) <= 2 and whole in LEFTOVERS else whole
