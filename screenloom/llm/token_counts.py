"""Token counts by a unigram model, with one dynamic program over a trie of the distinct pre-tokens.

Each node of the trie is a prefix; the best score of its segmentation is computed once and serves every pre-token that
shares it. Where a pre-token ends, the node's count is stored. Pre-tokens are deduplicated in each batch and the finished
counts are kept for the task, so nothing is shuffled and no model of the corpus is needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import chunks


def load_pieces(path: str | None = None) -> dict[bytes, float]:
    """Unigram log scores of a public vocabulary's pieces: ln 1/(rank + 2), by Zipf's law, as the file has ranks only."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out: dict[bytes, float] = {}
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            out[sp.id_to_piece(i).replace("▁", " ").encode()] = -math.log(len(out) + 2)
    return out


class TrieCounter:
    """Counts of the best segmentation of pre-tokens (space + word, as bytes).

    A byte without a piece is a token of its own with the score of the rarest piece less 10. Of equal scores, the
    segmentation with the longer last piece wins.
    """

    def __init__(self, pieces: dict[bytes, float], most: int = 300_000):
        self.pieces, self.most = pieces, most
        self.longest = max(map(len, pieces), default=1)
        self.byte = min(pieces.values(), default=0.0) - 10
        self.done: dict[bytes, int] = {}

    def add(self, words: set[bytes]) -> None:
        """Walks the sorted words as a trie: a stack holds the scores of the current path's prefixes."""
        if len(self.done) + len(words) > self.most:
            self.done.clear()
        pieces, longest, byte = self.pieces, self.longest, self.byte
        score, count, before = [0.0], [0], b""
        for word in sorted(words):
            n, k = min(len(before), len(word)), 0
            while k < n and before[k] == word[k]:
                k += 1
            del score[k + 1 :], count[k + 1 :]  # what lies beyond the shared prefix
            for end in range(k + 1, len(word) + 1):
                best, tokens = score[end - 1] + byte, count[end - 1] + 1
                for start in range(end - 1, max(-1, end - longest - 1), -1):
                    s = pieces.get(word[start:end])
                    if s is not None and score[start] + s >= best:
                        best, tokens = score[start] + s, count[start] + 1
                score.append(best)
                count.append(tokens)
            self.done[word] = count[len(word)]
            before = word

    def counts(self, texts: list[bytes]) -> tuple[list[int], list[int]]:
        split = [t.split() for t in texts]
        new = {b" " + w for ws in split for w in ws}
        if len(self.done) + len(new) > self.most:
            self.done.clear()
        self.add(new - self.done.keys())
        get = self.done
        return [len(ws) for ws in split], [sum([get[b" " + w] for w in ws]) for ws in split]


def token_counts(df: DataFrame, text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """Adds n_words and n_tokens (long) of the whole ``text``; both 0 for null, empty and blank texts.

    Pre-tokens are ASCII-white-space separated words with a space before. Columns of the new names give way; rows,
    repeated ones too, stay as they are. No shuffle.
    """
    base = df.drop(*[c for c in ("n_words", "n_tokens", "_raw") if c != text]).withColumn("_raw", F.col(text).cast("binary"))
    schema = T.StructType([*base.drop("_raw").schema.fields, T.StructField("n_words", T.LongType()), T.StructField("n_tokens", T.LongType())])
    pieces = load_pieces(vocabulary)

    def run(batches):
        counter = TrieCounter(pieces)
        for b in batches:
            words, tokens = [], []
            for _, _, texts in chunks(b.column(b.schema.get_field_index("_raw")).to_pylist(), 4 << 20):
                w, t = counter.counts(texts)
                words += w
                tokens += t
            kept = [(n, c) for n, c in zip(b.schema.names, b.columns, strict=True) if n != "_raw"]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [pa.array(np.array(x, np.int64)) for x in (words, tokens)], names=[n for n, _ in kept] + ["n_words", "n_tokens"])

    return base.mapInArrow(run, schema)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_counts(docs).select("doc_id", "n_words", "n_tokens")


QUERIES = {"op2_token_counts": op2_token_counts}
SQL: dict[str, str] = {}
