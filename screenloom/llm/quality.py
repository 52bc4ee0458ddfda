"""Quality rules: counts of a text, and a character n-gram perplexity within bands of its language.

The model is an interpolated modified Kneser-Ney model of five characters for each language, counted by Spark (in how many
texts an n-gram is) over every text and smoothed by joins of DataFrames. It is stored for look-ups as sorted arrays of n-gram hashes with values, a pair for
each order and one for its contexts. The arrays have 2 * ORDER * SLOTS places together, which the most frequent n-grams and
contexts of all orders take; so they are bounded whatever the corpus, and can be sent to all tasks. Of the others a bit each
is sent. Characters whose probability may depend on one of them are left open by the tasks and get it from the whole model by
joins, so none is lost.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Rolling, WordHash, chunks, forget, mix, written

#: Characters of the longest n-gram, bits of a character's sign (five fit a long), and places of a stored array on average.
ORDER, BITS, SLOTS = 5, 12, 1 << 19
SIGNS = 1 << BITS
#: Code points below this are signs of their own; those above share the other signs by a hash.
OWN_SIGNS = 3072
_WHITE_AND_TAILS = bytes([*range(9, 14), 32, *range(0x80, 0xC0)])
_SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def signs(points: np.ndarray) -> np.ndarray:
    far = OWN_SIGNS + (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(8)) % np.uint64(SIGNS - OWN_SIGNS)
    return np.where(points < OWN_SIGNS, points, far).astype(np.uint64)


#: ASCII punctuation.
_PUNCTUATION = np.array([chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in range(128)] + [False])


def ngram_codes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(code of the n-gram that ends at each character, number of its text, characters of each text). Sign 0 stands before
    a text. A run of one punctuation mark counts as one character: what follows from itself would hide how odd it is."""
    pad = "\0" * (ORDER - 1)
    low = [pad + t.decode("utf-8", "replace").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)
    own = np.repeat(np.arange(len(texts)), np.array([len(t) for t in low], np.int64))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != points[:-1]) | ~_PUNCTUATION[np.minimum(points[1:], 128)]
    each, own = signs(points[keep]), own[keep]
    code = np.zeros(max(0, len(each) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        code = (code << np.uint64(BITS)) | each[k : k + len(code)]
    # An n-gram of one text only ends at a character of the text itself.
    own, whole = own[ORDER - 1 :], own[ORDER - 1 :] == own[: len(code)]
    own = own[whole]
    return code[whole].view(np.int64), own, np.bincount(own, minlength=len(texts))


def lang_key(lang: str | None) -> int:
    """What stands for a language; a missing one is one of its own."""
    return zlib.crc32((lang or "").encode())


def _by_model(langs: list, texts: list[bytes], other: bool) -> Iterator[tuple[int, list[int]]]:
    """(model, places of its texts). Each language has two models, of halves of its texts by a hash of the text: a text
    counts in its own and is scored (``other``) by the other one, which neither it nor a copy of it is in."""
    at: dict[int, list[int]] = {}
    for i, (x, t) in enumerate(zip(langs, texts, strict=True)):
        at.setdefault(2 * lang_key(x) + (zlib.crc32(t) & 1 ^ other), []).append(i)
    yield from at.items()


def gram_hash(lang, order: int, code: np.ndarray) -> np.ndarray:
    """Hashes of n-grams (or contexts) of ``order`` signs; language and order may be arrays beside ``code``."""
    return mix(code.astype(np.uint64) + mix(np.atleast_1d(lang * 8 + order).astype(np.uint64)))


@dataclass(frozen=True)
class KneserNey:
    """For each order from 1: sorted hashes of n-grams and their log10 probabilities; sorted hashes of its contexts and
    their log10 back-off weights."""

    hashes: tuple[np.ndarray, ...]
    logs: tuple[np.ndarray, ...]
    context_hashes: tuple[np.ndarray, ...]
    backoffs: tuple[np.ndarray, ...]
    #: Bits, by hash, of the n-grams and contexts without a place; empty if all have one.
    lost: np.ndarray

    def log10(self, lang: int, codes: np.ndarray) -> np.ndarray:
        """log10 probability of the last sign of each code after those before it; nan where it may depend on an n-gram or
        context without a place."""
        value = np.full(len(codes), -np.log10(SIGNS))
        for k in range(1, ORDER + 1):
            own = codes & ((1 << BITS * k) - 1)
            context, gram = gram_hash(lang, k, own >> BITS), gram_hash(lang, k, own)
            value = value + _found(self.context_hashes[k - 1], self.backoffs[k - 1], context, _open(self.lost, ~context, 0.0))
            value = _found(self.hashes[k - 1], self.logs[k - 1], gram, _open(self.lost, gram, value))
        return value


class Lookup:
    """Values of a model by code, with a table of those looked up before: frequent codes are searched for once a task."""

    def __init__(self, model: KneserNey, bits: int = 21):
        self.model, self.bits = model, bits
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.float32)

    def log10(self, lang: int, codes: np.ndarray) -> np.ndarray:
        key = codes.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(np.array([lang + 1], np.uint64))
        slot = (key >> np.uint64(64 - self.bits)).view(np.int64)
        out, new = self.values[slot], np.flatnonzero(self.keys[slot] != key)
        if len(new):
            kinds, place = np.unique(codes[new], return_inverse=True)
            out[new] = self.model.log10(lang, kinds)[place]
            self.keys[slot[new]] = key[new]
            self.values[slot[new]] = out[new]  # of several of one slot the last stays in both
        return out


def _found(keys: np.ndarray, values: np.ndarray, asked: np.ndarray, default):
    if not len(keys):
        return np.broadcast_to(default, asked.shape)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, values[at], default)


def _bit(h: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(word of each hash among ``words``, its bit there)."""
    return (h >> np.uint64(6)) % np.uint64(words), np.uint64(1) << (h & np.uint64(63))


def _open(lost: np.ndarray, asked: np.ndarray, value):
    """``value``, or nan where the bit of the hash is set."""
    if not len(lost):
        return value
    word, bit = _bit(asked, len(lost))
    return np.where(lost[word.view(np.int64)] & bit != 0, np.nan, value)


def count_ngrams(df: DataFrame, text: str = "text", lang: str = "lang", held: int = 1 << 20) -> DataFrame:
    """(lang, code, n): texts that have each n-gram, over all whole texts; each task sums up to ``held`` n-grams before they move."""

    def run(batches):
        sums: dict[int, list] = {}

        def drain():
            for k, parts in sums.items():
                code, n = _merged(parts)
                for at in range(0, len(code), 1 << 16):
                    yield pd.DataFrame({"lang": k, "code": code[at : at + (1 << 16)], "n": n[at : at + (1 << 16)]})
            sums.clear()

        for pdf in batches:
            langs = pdf["lang"].tolist()
            for lo, hi, texts in chunks(pdf["text"]):
                for k, at in _by_model(langs[lo:hi], texts, False):
                    parts = sums.setdefault(k, [])
                    code, _, sizes = ngram_codes([texts[i] for i in at])
                    parts.append(_once(code, sizes))
                    if len(parts) > 8:
                        sums[k] = [_merged(parts)]
                if sum(len(c) for parts in sums.values() for c, _ in parts) > held:
                    yield from drain()
        yield from drain()

    each = df.select(F.col(text).cast("binary").alias("text"), F.col(lang).alias("lang")).mapInPandas(run, "lang long, code long, n long")
    return each.groupBy("lang", "code").agg(F.sum("n").alias("n"))


def _once(code: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, number of texts that have each). A text that repeats itself says no more than once."""
    kinds, at = [np.zeros(0, np.int64)], 0
    for n in sizes.tolist():
        x = np.sort(code[at : at + n])
        kinds.append(x[np.append(True, x[1:] != x[:-1])] if n else x)
        at += n
    return np.unique(np.concatenate(kinds), return_counts=True)


def _merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
    code, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
    return code, np.bincount(at, weights=np.concatenate([n for _, n in parts]), minlength=len(code)).astype(np.int64)


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """What is taken off counts of 1, 2, and 3 or more, from how many n-grams have a count of 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n2 / max(n1, 1)), (2, 2 - 3 * y * n3 / max(n2, 1)), (3, 3 - 4 * y * n4 / max(n3, 1)))]


def probabilities(counts: DataFrame) -> DataFrame:
    """(k, lang, code, context, p, back, n, total, head) of all n-grams of each order k: their probability, the back-off weight
    of their context, their count and their context's, and whether they are the one n-gram that stands for their context.
    Discounts are those of all languages together. ``counts`` are written.

    Lower orders count the signs that stand before an n-gram. Orders are joined on language and n-gram, never on a
    language alone but for single signs, of which a language has SIGNS at most.
    """
    by_order = {ORDER: counts.select("lang", "code", "n")}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = written(by_order[k + 1].groupBy("lang", F.col("code").bitwiseAND((1 << BITS * k) - 1).alias("code")).agg(F.count("*").alias("n")), "ngrams")
    found = below = None
    for k in range(1, ORDER + 1):
        own = by_order[k]
        ns = own.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first()
        d = discounts(*[float(x or 0) for x in ns])
        cut = F.when(F.col("n") >= 3, d[2]).when(F.col("n") == 2, d[1]).otherwise(d[0])
        own = own.select("lang", "code", "n", F.shiftright("code", BITS).alias("context"), cut.alias("cut"))
        context = own.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"), F.min("code").alias("first"))
        own = own.join(context, ["lang", "context"]).withColumn("back", F.col("cuts") / F.col("total"))
        if below is None:
            own = own.withColumn("q", F.lit(1.0 / SIGNS))
        else:
            own = own.join(below.select("lang", F.col("code").alias("rest"), F.col("p").alias("q")), (own["lang"] == below["lang"]) & (F.col("code").bitwiseAND((1 << BITS * (k - 1)) - 1) == F.col("rest")), "left").drop(below["lang"]).drop("rest")
        below = written(own.select(F.lit(k).alias("k"), "lang", "code", "context", ((F.col("n") - F.col("cut")) / F.col("total") + F.col("back") * F.col("q")).alias("p"), "back", "n", "total", (F.col("code") == F.col("first")).alias("head")), "smoothed")
        found = below if found is None else found.unionByName(below)
    for k in range(1, ORDER):
        forget(by_order[k])
    return found


def _level(n):
    """Of a count: rises with it, eight to a doubling."""
    return F.floor(8 * F.log2(n)).cast("int")


def stored(smoothed: DataFrame, slots: int = SLOTS) -> KneserNey:
    """The arrays: of the n-grams and contexts of all orders the most frequent, 2 * ORDER * ``slots`` at most, as whole levels
    of frequency (see _level), and bits of the others (see settled). So many values, and a bit for 256 times ``slots``, come
    to the driver at most."""
    kinds = smoothed.groupBy(_level("n").alias("gram"), F.when(F.col("head"), _level("total")).alias("context")).count().collect()
    sizes = pd.Series([r["count"] for r in kinds] * 2, [r["gram"] for r in kinds] + [r["context"] for r in kinds], dtype="int64")
    sizes = sizes[sizes.index.notna()].groupby(level=0).sum().sort_index(ascending=False)
    kept = sizes.index[sizes.cumsum() <= 2 * ORDER * slots]
    least = int(kept.min()) if len(kept) else 1 << 30
    words = 4 * slots

    def hashes(pdf: pd.DataFrame, of: int) -> np.ndarray:
        return gram_hash(pdf["lang"].to_numpy(), pdf["k"].to_numpy(np.int64), pdf["context" if of else "code"].to_numpy())

    def places(batches):
        for pdf in batches:
            for of, value in ((0, "p"), (1, "back")):
                own = pdf[pdf["at_context" if of else "at_gram"] >= least]
                yield pd.DataFrame({"at": (2 * own["k"] + of).astype(np.int32), "h": hashes(own, of).view(np.int64), "v": np.log10(own[value].to_numpy()).astype(np.float32)})

    def bits(batches):
        for pdf in batches:
            for of in (0, 1):
                own = pdf[pdf["at_context" if of else "at_gram"].between(0, least - 1)]
                h = hashes(own, of)
                word, bit = _bit(~h if of else h, words)  # of contexts the bits of the complement
                yield pd.DataFrame({"word": word.view(np.int64), "bit": bit.view(np.int64)})

    each = smoothed.select("k", "lang", "code", "context", "p", "back", _level("n").alias("at_gram"), F.when(F.col("head"), _level("total")).otherwise(-1).alias("at_context"))
    got = each.where((F.col("at_gram") >= least) | (F.col("at_context") >= least)).mapInPandas(places, "at int, h long, v float").toArrow()
    at, h, v = (got.column(c).to_numpy() for c in ("at", "h", "v"))
    out: tuple[list, ...] = ([], [], [], [])
    for k in range(1, ORDER + 1):
        for of in (0, 1):
            own = np.flatnonzero(at == 2 * k + of)
            own = own[np.argsort(h[own].view(np.uint64))]
            out[2 * of].append(h[own].view(np.uint64))
            out[2 * of + 1].append(v[own])
    lost = np.zeros(0, np.uint64)
    if len(kept) < len(sizes):
        rest = each.where(F.col("at_gram").between(0, least - 1) | F.col("at_context").between(0, least - 1)).mapInPandas(bits, "word long, bit long")
        got = rest.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
        lost = np.zeros(words, np.uint64)
        lost[got.column("word").to_numpy()] = got.column("bit").to_numpy().view(np.uint64)
    return KneserNey(*map(tuple, out), lost)


def train(df: DataFrame, text: str = "text", lang: str = "lang") -> KneserNey:
    """The stored model of all texts, each of its language."""
    return stored(_smoothed(df, text, lang))


def _smoothed(df: DataFrame, text: str, lang: str) -> DataFrame:
    counts = written(count_ngrams(df, text, lang), "ngram-counts")
    out = probabilities(counts)
    forget(counts)
    return out


def exact(smoothed: DataFrame, asked: DataFrame) -> DataFrame:
    """(lang, code, v): KneserNey.log10 of the codes of ``asked`` (lang, code; distinct) by all n-grams. Codes that are
    n-grams themselves have their own value; the others ask for their n-grams and contexts of every order in one join."""
    longest = smoothed.where(F.col("k") == ORDER).select("lang", "code", F.log10("p").alias("v"))
    tried = written(asked.join(longest, ["lang", "code"], "left"), "tried")
    rest = tried.where("v IS NULL").select("lang", "code")
    grams = smoothed.where(F.col("k") < ORDER).select("lang", (2 * F.col("k")).alias("at"), F.col("code").alias("g"), F.log10("p").alias("v"))
    contexts = smoothed.where("head").select("lang", (2 * F.col("k") + 1).alias("at"), F.col("context").alias("g"), F.log10("back").alias("v"))
    own = lambda k: F.col("code").bitwiseAND((1 << BITS * k) - 1)
    probes = [F.struct(F.lit(2 * k + of).alias("at"), (F.shiftright(own(k), BITS) if of else own(k)).alias("g")) for k in range(1, ORDER + 1) for of in (0, 1) if of or k < ORDER]
    got = rest.select("lang", "code", F.explode(F.array(*probes)).alias("x")).select("lang", "code", "x.*").join(grams.unionByName(contexts), ["lang", "at", "g"])
    is_gram = F.col("at") % 2 == 0
    found = got.groupBy("lang", "code").agg(F.max(F.when(is_gram, F.struct("at", "v"))).alias("top"), F.array_sort(F.collect_list(F.when(~is_gram, F.struct("at", "v")))).alias("backs"))
    after = F.aggregate(F.filter("backs", lambda x: x["at"] > F.coalesce(F.col("top.at") + 1, F.lit(0))), F.lit(0.0), lambda s, x: s + x["v"])
    lower = rest.join(found, ["lang", "code"], "left").select("lang", "code", (F.coalesce("top.v", F.lit(float(-np.log10(SIGNS)))) + F.coalesce(after, F.lit(0.0))).alias("v"))
    return tried.where("v IS NOT NULL").unionByName(lower)


#: What score leaves for settled: a row's number, its model, the sums and sizes of its stretches, and stretch and code of
#: each open character; the others are null where none is open.
_LEFT = {"_row": T.LongType(), "_model": T.LongType(), "_known": T.ArrayType(T.DoubleType()), "_size": T.ArrayType(T.LongType()), "_open_at": T.ArrayType(T.IntegerType()), "_open_code": T.ArrayType(T.LongType())}


def settled(scored: DataFrame, smoothed: DataFrame) -> DataFrame:
    """``scored`` (written, see score) with the log_ppl of rows with open characters, and without the columns _LEFT."""
    waiting = scored.where("_open_code IS NOT NULL")
    each = waiting.select("_row", F.col("_model").alias("lang"), F.explode(F.arrays_zip("_open_at", "_open_code")).alias("x")).select("_row", "lang", F.col("x._open_at").alias("at"), F.col("x._open_code").alias("code"))
    values = exact(smoothed, written(each.select("lang", "code").distinct(), "open"))
    got = each.join(values, ["lang", "code"]).groupBy("_row").agg(F.collect_list(F.struct("at", "v")).alias("got"))
    each_sum = lambda i: F.aggregate(F.filter("got", lambda y: y["at"] == i), F.lit(0.0), lambda s, y: s + y["v"])
    mean = F.transform(F.arrays_zip("_known", "_size"), lambda x, i: -(x["_known"] + each_sum(i)) / x["_size"])
    full = waiting.select("_row", "_known", "_size").join(got, "_row").select("_row", F.array_sort(mean).alias("l"))
    full = written(full.select("_row", F.element_at("l", ((F.size("l") + 1) / 2).cast("int")).alias("_ppl")), "settled")
    out = scored.join(full, "_row", "left").withColumn("log_ppl", F.coalesce("log_ppl", "_ppl"))
    return out.drop("_ppl", *_LEFT)


def text_counts(texts: list[bytes], cache: WordHash, window: int = 8) -> dict[str, np.ndarray]:
    n = len(texts)
    words: list[bytes] = []
    sizes = np.zeros(n, np.int64)
    dup = np.zeros(n, np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        words += w
        sizes[i] = len(w)
        lines = t.split(b"\n")
        if len(lines) > 1:
            full = [x for x in lines if x and not x.isspace()]
            dup[i] = len(full) - len(set(full))
    repeat = np.zeros(n, np.int64)
    if len(words) >= window:
        own = np.repeat(np.arange(n), sizes)
        h = Rolling(cache.of(words), 0x9E3779B97F4A7C15).windows(window)
        whole = own[: len(h)] == own[window - 1 :]
        at = np.flatnonzero(whole)
        key = mix(h[at] + own[at].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(key), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = np.zeros(len(words) + 1, np.int64)
        np.add.at(cover, at[twice], 1)
        np.add.at(cover, at[twice] + window, -1)
        repeat = np.bincount(own[np.cumsum(cover[:-1]) > 0], minlength=n)
    return {
        "n_words": sizes,
        "word_chars": np.array([len(t.translate(None, _WHITE_AND_TAILS)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, _SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def _stretches(own: np.ndarray, sizes: np.ndarray, length: int = 100) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(stretch of each value, number of each text's stretches, its first one)."""
    n = np.maximum(sizes // length, 1) * (sizes > 0)
    first = np.cumsum(n) - n
    return first[own] + np.minimum((np.arange(len(own)) - (np.cumsum(sizes) - sizes)[own]) // length, n[own] - 1), n, first


def _left(each: np.ndarray, code: np.ndarray, own: np.ndarray, sizes: np.ndarray) -> dict[int, tuple]:
    """By number of each text with open values (nan): what is left for settled, from _known on."""
    of, n, first = _stretches(own, sizes)
    known, size = np.bincount(of, weights=np.nan_to_num(each), minlength=n.sum()), np.bincount(of, minlength=n.sum())
    at = np.flatnonzero(np.isnan(each))
    ends = np.searchsorted(own[at], np.arange(len(sizes) + 1))
    out = {}
    for i in np.unique(own[at]).tolist():
        a, stop = at[ends[i] : ends[i + 1]], first[i] + n[i]
        out[i] = known[first[i] : stop], size[first[i] : stop], (of[a] - first[i]).astype(np.int32), code[a]
    return out


def median_stretch(each: np.ndarray, own: np.ndarray, sizes: np.ndarray, length: int = 100) -> np.ndarray:
    """Of the means of each text's stretches of ``length`` values (the last one is longer), the median (the lower of two);
    nan for no values. A quotation in another language or a key among prose doesn't move it."""
    of, n, first = _stretches(own, sizes, length)
    mean = np.bincount(of, weights=each, minlength=n.sum()) / np.maximum(np.bincount(of, minlength=n.sum()), 1)
    text = np.repeat(np.arange(len(sizes)), n)
    mean = mean[np.lexsort((mean, text))]
    out = np.full(len(sizes), np.nan)
    full = n > 0
    out[full] = mean[(first + (n - 1) // 2)[full]]
    return out


def score(df: DataFrame, model: KneserNey, text: str = "text", lang: str = "lang") -> DataFrame:
    """Adds the counts of BASE, base_failed and log_ppl (log10 of the perplexity of a character, of
    the text's median stretch; null for no characters).

    Null texts count as empty. Columns of these names in ``df`` give way. No shuffle; very long texts are whole. Texts
    with characters that ``model`` leaves open have no log_ppl yet but the columns _LEFT, for settled().
    """
    made = [*BASE, "log_ppl", *list(_LEFT)[1:]]
    base = df.drop(*[c for c in (*made, "_row", "base_failed", "_of") if c not in (text, lang)]).withColumn("_of", F.col(lang).cast("string"))
    schema = T.StructType([*base.drop("_of").schema.fields, *[T.StructField(c, T.LongType()) for c in BASE], T.StructField("log_ppl", T.DoubleType()), *[T.StructField(c, t) for c, t in list(_LEFT.items())[1:]]])
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        cache, lookup = WordHash(7), Lookup(sent.value)
        for b in batches:
            parts: dict[str, list] = {c: [] for c in (*BASE, "log_ppl")}
            left: list[tuple] = []
            langs = b.column(b.schema.get_field_index("_of")).to_pylist()
            for lo, hi, texts in chunks(b.column(b.schema.get_field_index(text)).cast(pa.binary()).to_pylist()):
                for k, v in text_counts(texts, cache).items():
                    parts[k].append(v)
                ppl, rest = np.full(len(texts), np.nan), [(None,) * (len(_LEFT) - 1)] * len(texts)
                for of, at in _by_model(langs[lo:hi], texts, True):
                    code, own, sizes = ngram_codes([texts[i] for i in at])
                    each = lookup.log10(of, code)
                    ppl[at] = median_stretch(-each, own, sizes)
                    for i, x in _left(each, code, own, sizes).items():
                        ppl[at[i]] = np.nan
                        rest[at[i]] = (of, *x)
                parts["log_ppl"].append(ppl)
                left += rest
            cols = [np.concatenate(v) if v else np.zeros(0) for v in parts.values()]
            arrays = [pa.array(c, pa.int64()) for c in cols[:-1]] + [pa.array(cols[-1], pa.float64(), mask=np.isnan(cols[-1]))]
            kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            arrays += [pa.array([x[j] for x in left], kind) for j, kind in enumerate(kinds)]
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_of"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + arrays, names=[n for n, _ in kept] + made)

    out = base.mapInArrow(run, schema).withColumn("_row", F.monotonically_increasing_id())
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def bands(scored: DataFrame, lang: str = "lang", reach: tuple[float, float] = (8.0, 3.0), floor: float = 0.01, pool: int = 50) -> DataFrame:
    """(_band_lang, _band_low, _band_high) of log_ppl by language, over all its scored texts that pass the base rules.

    The band reaches ``reach`` (down, up) times the distance from the language's median to its quartile on either side
    (``floor`` at least). 3 is fitted to the labels of sf0.1, where it leaves out 258 of 301 bad texts that pass the base
    rules and 5 of 3302 good ones. Down it is wide, for texts with many near copies are foreseen well and no worse for that. As few
    texts say little of the quartiles, their distance is mixed with that of all languages, which counts as ``pool`` texts.
    A missing language is one of its own.
    """
    fine = scored.where("NOT base_failed AND log_ppl IS NOT NULL")
    q = fine.groupBy(F.coalesce(F.col(lang), F.lit("")).alias("_band_lang")).agg(F.percentile_approx("log_ppl", [0.25, 0.5, 0.75], 10000).alias("q"), F.count("*").alias("n"))
    q = written(q, "quartiles")
    mid = F.col("q")[1]
    down, up = mid - F.col("q")[0], F.col("q")[2] - mid
    of_all = q.agg(F.sum(F.col("n") * down) / F.sum("n"), F.sum(F.col("n") * up) / F.sum("n")).first()
    wide = lambda d, of, times: times * F.greatest((F.col("n") * d + F.lit(float(pool * (of or 0)))) / (F.col("n") + pool), F.lit(floor))
    return q.select("_band_lang", (mid - wide(down, of_all[0], reach[0])).alias("_band_low"), (mid + wide(up, of_all[1], reach[1])).alias("_band_high"))


#: Up to so many bands are broadcast, so the rows of a frequent language stay where they are; more bands are joined by shuffle.
MOST_BANDS = 4096


def verdict(scored: DataFrame, banded: DataFrame, lang: str = "lang", noise: float = 1.2) -> DataFrame:
    """Adds kept: false where base_failed or log_ppl is outside the language's band, else true.

    The band is wider by ``noise`` / sqrt(characters of the words), about two deviations of a short text's mean.
    """
    banded = written(banded, "bands")
    side = F.broadcast(banded) if banded.count() <= MOST_BANDS else banded
    joined = scored.join(side, F.coalesce(F.col(lang), F.lit("")) == F.col("_band_lang"), "left")
    slack = F.lit(noise) / F.sqrt(F.greatest(F.col("word_chars"), F.lit(1)))
    out = F.coalesce((F.col("log_ppl") < F.col("_band_low") - slack) | (F.col("log_ppl") > F.col("_band_high") + slack), F.lit(False))
    return joined.withColumn("kept", ~F.col("base_failed") & ~out).drop("_band_lang", "_band_low", "_band_high")


def _scored(df: DataFrame, asked: DataFrame, text: str, lang: str, unless: tuple[str, ...] = ()) -> DataFrame:
    """score of the rows ``asked`` by the model of ``df``, settled and written, without the columns ``unless``."""
    smoothed = _smoothed(df, text, lang)
    model = stored(smoothed)
    if not len(model.lost):
        forget(smoothed)
        return written(score(asked, model, text, lang).drop(*_LEFT, *unless), "quality")
    return settled(written(score(asked, model, text, lang).drop(*unless), "quality"), smoothed)


def judge(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id") -> DataFrame:
    """Counts, log_ppl, base_failed and kept of every row of ``df`` (see score, bands and verdict), without the text."""
    small = df.select(*dict.fromkeys([key, lang, text]))
    scored = _scored(df, small, text, lang, (text,))
    return verdict(scored, bands(scored, lang), lang)


def keep(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``df`` that judge() keeps, with the columns of ``df``; they are written once with their scores. Clashing
    names come back as they were. Empty tables give none; repeated rows are judged alike."""
    own = {c: f"_own_{c}" for c in df.columns if c in (*BASE, *_LEFT, "log_ppl", "_ppl", "base_failed", "kept", "_of") and c not in (text, lang)}
    scored = _scored(df, df.withColumnsRenamed(own), text, lang)
    out = verdict(scored, bands(scored, lang), lang).where("kept")
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in df.columns])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return judge(docs).select("doc_id", *BASE, "base_failed", "kept", "log_ppl")


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
