"""URL, key, split and shard expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import AD_FRAME_HOSTS, TRACKING_FRAME_HOSTS

_URL = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.-]*):)?(//[^/?#]*)?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _URL, group)


def _decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _encoded(c: Column) -> Column:
    """Form encoding; letters, digits and _.-~ stay."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Without ``utm_`` parameters and fragment, with parameters decoded, sorted by name and value and encoded again."""
    pieces = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    pairs = F.transform(pieces, lambda p: F.struct(_decoded(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(pairs, lambda x: ~F.startswith(F.lower(x["k"]), F.lit("utm_"))))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_encoded(x["k"]), F.lit("="), _encoded(x["v"]))), "&")
    scheme = F.lower(part(url, 1))
    return F.concat(F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit("")), part(url, 2), part(url, 3), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))


def stable_hash(s: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(s, 256), 1, length)


def safe_stem(url: Column, most: int = 80) -> Column:
    """A readable name from host and path: ASCII letters and digits, runs of others as one hyphen, ``page`` if empty.

    Accented letters lose their accents (NFKD with marks dropped); scripts without an ASCII form leave nothing.
    """
    base = F.concat(F.regexp_replace(part(url, 2), "^//", ""), F.lit("-"), part(url, 3))
    folded = F.translate(F.lower(base), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    slug = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    cut = F.substring(slug, 1, most)
    return F.when(cut == "", F.lit("page")).otherwise(cut)


def file_base(url: Column) -> Column:
    return F.concat_ws("-", safe_stem(url), stable_hash(canonical(url)))


def split_of(stem: Column, train: float, val: float, test: float, seed: int = 42) -> Column:
    """train, val or test by a hash of seed and stem: no order, no shuffle, and the same for any set of rows."""
    if abs(train + val + test - 1) >= 1e-6:
        raise ValueError("ratios must sum to 1")
    first = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), stem)), 1, 15)
    r = F.conv(first, 16, 10).cast("long") / F.lit(float(16**15))
    return F.when(r < train, "train").when(r < train + val, "val").otherwise("test")


def frame_kind(host: Column, w: Column, h: Column) -> Column:
    """ad or tracking by the host's end, tracking for frames of a pixel, else content."""
    low = F.lower(host)
    ends = lambda names: F.exists(F.array(*map(F.lit, names)), lambda n: F.endswith(low, n))
    return F.when(ends(AD_FRAME_HOSTS), "ad").when(ends(TRACKING_FRAME_HOSTS) | (w <= 1) | (h <= 1), "tracking").otherwise("content")
