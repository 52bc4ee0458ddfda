"""Benchmark decontamination by latent semantic retrieval.

Benchmark passages, in parts of a window at most, become TF-IDF rows over hashed terms, with document frequencies of the
whole corpus. A randomised SVD of each block of rows, no more than its rank, gives the block's latent space. Document
windows are projected into it and those with a high cosine to a part are candidates; a longest common subsequence of words
and a check of the passage's end decide.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WordHash, chunks, written

DIMS = 1 << 14
#: Words of the longest part of a passage, those of the largest window; blocks that a task holds at once.
PART, BLOCKS = 48, 8
_STRIP = b".,;:!?\"'()[]{}*#$%&|<>"


def terms(text: bytes) -> list[bytes]:
    """Words without signs around them, A-Z lower-cased; those of signs only stay out."""
    return [w for w in (x.strip(_STRIP) for x in text.lower().split()) if w]


class Vocabulary:
    """Terms of the benchmark; its size is the benchmark's. -1 is any other term."""

    def __init__(self, words):
        self.ids = {w: i for i, w in enumerate(sorted(words))}

    def of(self, words: list[bytes]) -> np.ndarray:
        get = self.ids.get
        return np.fromiter([get(w, -1) for w in words], np.int32, len(words))


def document_frequencies(docs: DataFrame, vocabulary: Vocabulary, text: str) -> tuple[int, np.ndarray]:
    """(documents, frequency of each benchmark term) over every whole document."""
    size = len(vocabulary.ids)

    def run(batches):
        df, n = np.zeros(size + 1, np.int64), 0
        for pdf in batches:
            for _, _, texts in chunks(pdf["text"]):
                for t in texts:
                    ids = vocabulary.of(list(set(terms(t))))
                    df[ids[ids >= 0]] += 1
                    n += 1
        df[size] = n
        at = np.flatnonzero(df)
        yield pd.DataFrame({"k": at, "n": df[at]})

    got = docs.select(F.col(text).cast("binary").alias("text")).mapInPandas(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 1, np.int64)
    df[got["k"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return int(df[size]), df[:size]


def _bucket(words: list[bytes]) -> np.ndarray:
    return (WordHash(5).of(words) % np.uint64(DIMS)).astype(np.int64)


def latent_bases(rows: DataFrame, idf: dict[bytes, float], rank: int, seed: int = 7) -> dict[int, np.ndarray]:
    """For each block its right singular vectors (DIMS, rank) of the TF-IDF rows (block, terms array<binary>), by a
    randomised SVD from A'(A W) for a random W. A block is a task's; its vectors come to the driver.
    """

    def svd(pdf):
        each = [weigh([bytes(x) for x in words], idf)[:2] for words in pdf["terms"]]
        dims = np.unique(np.concatenate([at for at, _ in each]))  # the others are zero
        start = np.random.default_rng(seed).standard_normal((DIMS, rank + 8), np.float32)[dims].astype(float)
        z = np.zeros(start.shape)
        for at, w in each:
            np.add.at(z, np.searchsorted(dims, at), np.outer(w, w @ start[np.searchsorted(dims, at)]))
        # Singular vectors of the Nystroem form of A'A; the null directions go.
        q, r = np.linalg.qr(z)
        u, s, _ = np.linalg.svd(r @ np.linalg.pinv(start.T @ z) @ r.T)
        keep = s > 1e-6 * max(s[0], 1e-12)
        found = (q @ u[:, keep])[:, : min(rank, len(each))].astype(np.float32)
        return pd.DataFrame({"block": pdf["block"][:1], "dims": [dims.tobytes()], "v": [found.tobytes()]})

    out = {}
    for r in rows.groupBy("block").applyInPandas(svd, "block long, dims binary, v binary").collect():
        dims = np.frombuffer(r.dims, np.int64)
        found = np.frombuffer(r.v, np.float32).reshape(len(dims), -1)
        out[r.block] = np.zeros((DIMS, found.shape[1]), np.float32)
        out[r.block][dims] = found
    return out


def weigh(words: list[bytes], idf: dict[bytes, float]) -> tuple[np.ndarray, np.ndarray, float]:
    """Hashed places and unit TF-IDF weights of the words, and their length before; repeated ones weigh 1 + ln(count)."""
    bag = Counter(words)
    at = _bucket(list(bag))
    w = np.array([(1 + math.log(c)) * idf[x] for x, c in bag.items()])
    length = max(float(np.linalg.norm(w)), 1e-12)
    return at, w / length, length


def lcs(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        if x >= 0:
            at[x] = at.get(x, 0) | 1 << i
    v = full = (1 << len(a)) - 1
    for x in b.tolist():
        m = at.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def parts(words: list[bytes]) -> list[list[bytes]]:
    """The words in as few even parts of at most PART words as there can be."""
    n = -(-len(words) // PART)
    return [words[len(words) * i // n : len(words) * (i + 1) // n] for i in range(n)]


class Block:
    """Up to a rank of parts in a latent space of their own. ``ids`` are those of their words; ``owners`` the parts' items."""

    def __init__(self, ids: np.ndarray, idf: np.ndarray, words: list[bytes], own: list[list[bytes]], owners: list[int], idf_of: dict[bytes, float], size: int, basis: np.ndarray):
        self.local = np.full(size + 1, -1, np.int32)  # the last is for other words
        self.local[ids] = np.arange(len(ids))
        self.owners = owners
        self.rows = (idf[:, None] * basis[_bucket(words)]).astype(np.float32)
        latent = []
        for ws in own:
            at, w, length = weigh(ws, idf_of)
            latent.append(length * (w @ basis[at]))
        x = np.array(latent)
        self.lengths = np.maximum(np.linalg.norm(x, axis=1), 1e-9).astype(np.float32)
        self.latent = (x / self.lengths[:, None]).astype(np.float32)
        #: The largest share of a part's length that a word can give; 0 for other words.
        self.most = np.append(np.maximum((self.rows @ self.latent.T / self.lengths).max(1), 0), 0.0)


class Index:
    """Benchmark passages in latent spaces, and the search of whole texts against them."""

    def __init__(self, items: list[tuple[int, bytes]], n: int, df: np.ndarray, vocabulary: Vocabulary, rank: int = 256):
        self.vocabulary = vocabulary
        self.idf_of = {w: math.log((n + 1) / (df[i] + 0.5)) + 0.05 if df[i] < n else 0.05 for w, i in vocabulary.ids.items()}
        self.items = [(i, vocabulary.of(terms(t)), terms(t)) for i, t in items]
        self.items = [x for x in self.items if len(x[1])]
        own = [(c, ws) for c, x in enumerate(self.items) for ws in parts(x[2])]
        n_blocks = -(-len(own) // rank)
        #: (item's place, words) of the parts of each block
        self.parts = [own[len(own) * i // n_blocks : len(own) * (i + 1) // n_blocks] for i in range(n_blocks)]
        self.blocks: list[Block] = []

    def project(self, *bases: np.ndarray) -> None:
        self.blocks = []
        for own, basis in zip(self.parts, bases, strict=True):
            words = sorted({w for _, ws in own for w in ws})
            idf = np.array([self.idf_of[w] for w in words])
            self.blocks.append(Block(self.vocabulary.of(words), idf, words, [ws for _, ws in own], [c for c, _ in own], self.idf_of, len(self.vocabulary.ids), basis))

    def search(self, text: bytes, least: float, share: float, answer: float, sizes=(24, 48)) -> list[tuple[int, float, float, bool]]:
        """(item, cosine, share of its words in common order, end found) of the passages that the text holds.

        The cosine is that of the projected window, which counts as no shorter than the projected passage: words outside
        the benchmark don't lengthen it however rare they are, and a few words of a passage aren't near it.
        """
        ids = self.vocabulary.of(terms(text))
        if not self.items or not (ids >= 0).any():
            return []
        best: dict[int, tuple[float, int, int]] = {}
        tried: dict[tuple, tuple[int, int]] = {}
        for block in self.blocks:
            own = block.local[ids]
            # A window's product with a part is at most the sum of its words' largest ones, as 1 + ln(count) is at most
            # the count; divided by the part's length it is at least the cosine, so other windows can't reach ``least``.
            bound = np.concatenate([[0], np.cumsum(block.most[own])])
            for size in sizes:
                start = np.arange(0, max(1, len(ids) - size // 2), size // 2)
                stop = np.minimum(start + size, len(ids))
                may = bound[stop] - bound[start] >= 0.999 * least
                start, stop = start[may], stop[may]
                for at in range(0, len(start), 2048):
                    first, last = start[at : at + 2048], stop[at : at + 2048]
                    x = self._projected(block, own, first, last, size)
                    cos = (x @ block.latent.T) / np.maximum(np.linalg.norm(x, axis=1)[:, None], block.lengths)
                    for r, c in zip(*np.nonzero(cos >= least), strict=True):
                        self._try(best, tried, block.owners[c], float(cos[r, c]), ids, int(first[r]), int(last[r]))
        out = []
        for c, (cos, common, end) in best.items():
            n = len(self.items[c][1])
            tail = max(3, n // 5)
            if common >= share * n and (end >= answer * min(tail, n) or common >= (share + 0.2) * n):
                out.append((self.items[c][0], cos, common / n, end >= answer * min(tail, n)))
        return out

    def _projected(self, block: Block, ids: np.ndarray, start: np.ndarray, stop: np.ndarray, size: int) -> np.ndarray:
        """The windows in latent space; repeated terms of a window weigh 1 + ln(count)."""
        wide = np.minimum(start[:, None] + np.arange(size), len(ids) - 1)
        inside = (start[:, None] + np.arange(size) < stop[:, None]) & (ids[wide] >= 0)
        pair = np.sort((np.arange(len(start))[:, None] << 32 | ids[wide])[inside])
        new = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]]))
        count = np.diff(np.append(new, len(pair)))
        whose = pair[new] >> 32
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
        x = np.zeros((len(start), block.rows.shape[1]), np.float32)
        x[whose[first]] = np.add.reduceat(block.rows[pair[new] & 0xFFFFFFFF] * (1 + np.log(count))[:, None].astype(np.float32), first, axis=0)
        return x

    def _try(self, best: dict, tried: dict, c: int, cos: float, ids: np.ndarray, start: int, stop: int) -> None:
        item = self.items[c][1]
        n = len(item)
        if n > PART:  # the windows of a long passage share their surroundings
            start -= start % (n // 4)
            stop = start + n // 4 + PART
        if (c, start, stop) not in tried:
            around = ids[max(0, start - n) : stop + n]
            tried[c, start, stop] = lcs(item, around), lcs(item[-max(3, n // 5) :], around)
        common, end = tried[c, start, stop]
        old = best.get(c)
        if old is None or (common, cos) > (old[1], old[0]):
            best[c] = (cos, common, end)


def build_indexes(docs: DataFrame, benchmark: DataFrame, text: str, item: str, item_text: str, rank: int, most_bytes: int) -> Iterator[Index]:
    """Indexes of passages with BLOCKS blocks about; a passage is whole in one of them."""
    size = benchmark.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"the benchmark has {size} bytes, more than most_bytes; pass its parts one by one")
    items = [(r[0], (r[1] or "").encode()) for r in benchmark.select(item, item_text).where(F.col(item).isNotNull()).collect()]
    vocabulary = Vocabulary({w for _, t in items for w in terms(t)})
    n, df = document_frequencies(docs, vocabulary, text)
    groups, held = [[]], 0
    for x in items:
        more = -(-len(terms(x[1])) // PART)
        if groups[-1] and held + more > BLOCKS * rank:
            groups.append([])
            held = 0
        groups[-1].append(x)
        held += more
    kind = T.StructType([T.StructField("block", T.LongType()), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    for group in groups:
        own = Vocabulary({w for _, t in group for w in terms(t)})
        index = Index(group, n, df[vocabulary.of(list(own.ids))], own, rank)
        if index.parts:
            rows = docs.sparkSession.createDataFrame([(k, ws) for k, block in enumerate(index.parts) for _, ws in block], kind)
            bases = latent_bases(rows, index.idf_of, rank)
            index.project(*[bases[k] for k in range(len(index.parts))])
        yield index


def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", least: float = 0.35, share: float = 0.6, answer: float = 0.5, rank: int = 256, most_bytes: int = 64 << 20) -> DataFrame:
    """(key, item, cosine, lcs_share, answer_found): each passage of ``benchmark`` that a row of ``docs`` holds.

    Windows of 24 and 48 words, half overlapping, at a latent cosine of ``least`` or more to a passage, or a part of a longer
    one, are candidates. Passages are searched in blocks of ``rank`` parts, and BLOCKS blocks a pass over ``docs``. A candidate counts if at least
    ``share`` of the passage's words stand in the text near the window in the passage's order, and ``answer`` of its last
    fifth too (or ``share`` + 0.2 of all). The benchmark is checked to be at most ``most_bytes``. Null and empty texts
    and passages match nothing; repeated rows match each on their own.
    """
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField(item, benchmark.schema[item].dataType), T.StructField("cosine", T.DoubleType()), T.StructField("lcs_share", T.DoubleType()), T.StructField("answer_found", T.BooleanType())])

    def searched(index):
        def run(batches):
            for pdf in batches:
                out = []
                for k, t in zip(pdf["key"].tolist(), pdf["text"], strict=True):
                    out += [(k, *x) for x in index.search(t or b"", least, share, answer)]
                yield pd.DataFrame(out, columns=[f.name for f in schema.fields])

        return docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("text")).where("key IS NOT NULL").mapInPandas(run, schema)

    found = None
    for index in build_indexes(docs, benchmark, text, item, item_text, rank, most_bytes):
        found = searched(index) if found is None else found.unionByName(searched(index))
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that hold no passage of ``benchmark``. Rows with null keys can't be named and stay."""
    gone = written(contaminated(docs, benchmark, text, key, item, item_text, **how).select(F.col(key).alias("_gone")).distinct(), "contaminated")
    return docs.join(gone, F.col(key) == F.col("_gone"), "left_anti")


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op4_decontaminate": op4_decontaminate}
SQL: dict[str, str] = {}
