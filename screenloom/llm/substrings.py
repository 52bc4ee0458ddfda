"""Removal of passages that repeat across documents, by level-wise doubling.

Level 1 looks at windows of half the length. Of those in a window of full length, the one with the smallest hash stands
for it, so a repeated full window always has a repeated half window, and only one in about a dozen half windows is moved.
Those found in two documents are extended to twice their length. All full windows that one half window stands for are
first compared as a whole by a hash of their joint words; only where these differ are they compared one by one. At each
further level the length doubles, as long as any candidate is left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import Rolling, WordHash, chunks, mix, written

_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def _words(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    words: list[bytes] = []
    sizes = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = t.split()
        words += w
        sizes[i] = len(w)
    return words, sizes


def _sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """For each start, where the smallest of ``width`` values is (the first of equals)."""
    at, size = np.arange(len(h)), 1
    pick = lambda a, b: np.where(h[a] <= h[b], a, b)
    while 2 * size <= width:
        at = pick(at[:-size], at[size:])
        size *= 2
    more = width - size
    return pick(at[:-more], at[more:]) if more else at


def stretches(texts: list[bytes], length: int, cache: WordHash) -> dict[str, np.ndarray]:
    """Runs of full windows with one half window standing for them: half, joint (hashes), own (text), first, last (starts)."""
    half_len = length // 2
    words, sizes = _words(texts)
    empty = {k: np.zeros(0, np.int64) for k in ("own", "first", "last")} | {k: np.zeros(0, np.uint64) for k in ("half", "joint")}
    if len(words) < length:
        return empty
    h = cache.of(words)
    own = np.repeat(np.arange(len(texts)), sizes)
    one, two = Rolling(h, _B1), Rolling(mix(h), _B2)
    halves = one.windows(half_len)
    low = _sliding_argmin(halves, length - half_len + 1)[: len(words) - length + 1]
    ok = np.flatnonzero(own[: len(low)] == own[length - 1 : length - 1 + len(low)])
    if not len(ok):
        return empty
    m = low[ok]
    new = np.concatenate([[True], (m[1:] != m[:-1]) | (ok[1:] != ok[:-1] + 1)])
    first = ok[new]
    last = ok[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ok) - 1]])]
    p = low[first]
    joint = mix(two.at(first, last + length) + (p - first).astype(np.uint64) * np.uint64(64) + (last - first).astype(np.uint64))
    base = np.cumsum(sizes) - sizes
    return {"half": halves[p], "joint": joint, "own": own[first], "first": first - base[own[first]], "last": last - base[own[first]]}


def _key(df: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, th, raw): the key, and a hash of the text that tells rows with one key apart."""
    return df.select(F.col(key).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).cast("binary").alias("raw"))


def _half_windows(docs: DataFrame, length: int) -> DataFrame:
    def run(batches):
        cache = WordHash(11)
        for b in batches:
            doc, th = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy()
            for lo, _, texts in chunks(b.column(2).to_pylist()):
                s = stretches(texts, length, cache)
                at = s["own"] + lo
                yield pa.RecordBatch.from_arrays([pa.array(s["half"].view(np.int64)), pa.array(s["joint"].view(np.int64)), pa.array(doc[at].astype(np.int64)), pa.array(th[at]), pa.array(s["first"].astype(np.int32)), pa.array(s["last"].astype(np.int32))], names=["half", "joint", "doc", "th", "first", "last"])

    return docs.mapInArrow(run, "half long, joint long, doc long, th long, first int, last int")


def _single_windows(docs: DataFrame, length: int) -> DataFrame:
    """docs (doc, th, raw, runs of (half, first, last)) to a row for each full window of the runs."""

    def run(batches):
        cache = WordHash(11)
        for pdf in batches:
            for lo, hi, texts in chunks(pdf["raw"]):
                words, sizes = _words(texts)
                roll = Rolling(mix(cache.of(words)), _B2)
                for i, base in zip(range(lo, hi), (np.cumsum(sizes) - sizes).tolist(), strict=True):
                    runs = pdf["runs"][i]
                    first, last = np.array([r["first"] for r in runs]), np.array([r["last"] for r in runs])
                    n = last - first + 1
                    start = np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    yield pd.DataFrame({"half": np.repeat(np.array([r["half"] for r in runs]), n), "window": roll.at(start + base, start + base + length).view(np.int64), "doc": pdf["doc"][i], "th": pdf["th"][i], "first": start.astype(np.int32)})

    return docs.mapInPandas(run, "half long, window long, doc long, th long, first int")


def repeated_spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> DataFrame:
    """(doc, th, first, last): starts of the windows of ``length`` words whose word sequence also starts in a row with a
    smaller key. Spans may meet or repeat. Rows with null keys are in no span and make none.
    """
    docs = _key(df, text, key).where("doc IS NOT NULL")
    runs = written(_half_windows(docs, length), "half-windows")
    # Level 1: half windows in two documents. Sums are made before rows move, so a frequent passage is a row a task.
    joint = runs.groupBy("half", "joint").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
    joint = written(joint, "joint")
    half = joint.groupBy("half").agg(F.min("low").alias("a"), F.max("high").alias("b"), F.count("*").alias("kinds")).where("a < b")
    known = joint.where("low < high").select("half", "joint", "low").withColumn("kinds", F.lit(1)).join(half.where("kinds = 1").select("half"), "half", "left_semi")
    mixed = joint.join(half.where("kinds > 1").select("half"), "half").select("half", "joint", "low", F.lit(2).alias("kinds"))
    cand = written(runs.join(known.unionByName(mixed), ["half", "joint"]).where("doc > low OR kinds > 1"), "candidates")
    whole = cand.where("doc > low").select("doc", "th", "first", "last")
    # Level 2, one by one: of each kind of joint words only its first document, for the others follow it.
    firsts = cand.where("doc = low AND kinds > 1").groupBy("doc", "th").agg(F.collect_list(F.struct("half", "first", "last")).alias("runs"))
    windows = written(_single_windows(docs.join(firsts, ["doc", "th"]), length), "windows")
    low = windows.groupBy("half", "window").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("half", "window", "low")
    single = windows.join(low, ["half", "window"]).where("doc > low").select("doc", "th", "first", F.col("first").alias("last"))
    return whole.unionByName(single)


def drop_repeats(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> DataFrame:
    """Adds kept_text, n_words and n_removed to ``df``; columns of those names give way.

    A word is removed if a window of ``length`` words over it also starts in a row with a smaller key; windows are those
    of the input. kept_text is the text as it is where nothing is removed, else the kept words joined by one space.
    Null, empty and short texts lose nothing; null texts stay null; rows with null keys are kept whole; rows of one key
    don't remove each other's words.
    """
    spans = repeated_spans(df, text, key, length)
    by_doc = spans.groupBy(F.col("doc").alias("_s_doc"), F.col("th").alias("_s_th")).agg(F.collect_list(F.struct("first", "last")).alias("_spans"))
    made = ("kept_text", "n_words", "n_removed")
    base = df.drop(*[c for c in made if c not in (text, key)])
    joined = base.withColumns({"_s_d": F.col(key).cast("long"), "_s_t": F.xxhash64(F.coalesce(F.col(text), F.lit("")))}).join(by_doc, (F.col("_s_d") == F.col("_s_doc")) & (F.col("_s_t") == F.col("_s_th")), "left")
    joined = joined.select(*base.columns, F.col(text).cast("binary").alias("_s_raw"), F.col("_spans.first").alias("_s_first"), F.col("_spans.last").alias("_s_last"))

    schema = T.StructType([*base.schema.fields, T.StructField("kept_text", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def run(batches):
        for b in batches:
            get = lambda c: b.column(b.schema.get_field_index(c)).to_pylist()
            kept, n_words, n_removed = [], [], []
            for raw, first, last in zip(get("_s_raw"), get("_s_first"), get("_s_last"), strict=True):
                words = (raw or b"").split()
                n, gone = len(words), 0
                if first and n >= length:
                    cover = np.zeros(n + 1, np.int32)
                    np.add.at(cover, np.array(first), 1)
                    np.add.at(cover, np.array(last) + length, -1)
                    cut = np.cumsum(cover[:-1]) > 0
                    gone = int(cut.sum())
                if gone:
                    raw = b" ".join([w for w, c in zip(words, cut.tolist(), strict=True) if not c])
                kept.append(raw)
                n_words.append(n)
                n_removed.append(gone)
            names = [c for c in b.schema.names if c not in ("_s_raw", "_s_first", "_s_last")]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in names] + [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())], names=[*names, *made])

    return joined.mapInArrow(run, schema)


def words_sha256(text: str):
    """Hex SHA-256 of the words of ``text`` joined by one space."""
    whole = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return F.sha2(F.regexp_replace(whole, "^ | $", "").cast("binary"), 256)


def keep_new(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = 50) -> DataFrame:
    """``df`` with its texts less repeated passages; rows of which no word is left go."""
    out = drop_repeats(df, text, key, length).where("n_removed = 0 OR n_removed < n_words")
    return out.select(*[F.col("kept_text").alias(c) if c == text else c for c in df.columns])


def op6_substrings(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = drop_repeats(docs)
    return out.select("doc_id", "n_words", "n_removed", words_sha256("kept_text").alias("kept_sha256"))


QUERIES = {"op6_substrings": op6_substrings}
SQL = {
    "op6_substrings": r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(ws) - 48)) AS i, ws FROM docs WHERE len(ws) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM starts),
firsts AS (SELECT h, min(doc_id) AS low FROM windows GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS at FROM windows JOIN firsts USING (h) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS at FROM docs),
kept AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.at) AS t, count(*) AS n FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.at = w.at GROUP BY w.doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
}
