"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_loaded: dict[str, object] = {}


def load_ranks(path: str | None) -> bytes:
    """The rank file's bytes; without a path, the public 50k byte-level vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoding(ranks: bytes, pattern: str, most: int | None = None):
    """A tiktoken encoding of the first ``most`` ranks, one a process."""
    key = hashlib.md5(ranks + pattern.encode() + str(most).encode()).hexdigest()
    if key not in _loaded:
        import tiktoken

        pairs = (line.split() for line in ranks.splitlines() if line)
        known = {base64.b64decode(a): int(b) for a, b in pairs}
        if most is not None:
            known = {a: b for a, b in known.items() if b < most}
        _loaded[key] = tiktoken.Encoding(key, pat_str=pattern, mergeable_ranks=known, special_tokens={})
    return _loaded[key]


def safe_pieces(text: str, most: int) -> Iterator[str]:
    """Pieces of about ``most`` characters, cut only where no match of the pattern can span.

    Such a place is before a space or line feed that follows a letter, digit or ASCII sign: white space can only begin a
    match that holds anything else, so matches on either side are those of the whole text. Where a text has no such
    place, the piece goes on to the next one or the end.
    """
    at, n = 0, len(text)
    while n - at > most:
        cut = at + most
        while cut < n and not (text[cut] in " \n" and (text[cut - 1].isalnum() or "!" <= text[cut - 1] <= "~")):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < n or not n:
        yield text[at:]


def encode_text(enc, text: str, piece_chars: int = 65536) -> list[int]:
    if len(text) <= piece_chars:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for piece in safe_pieces(text, piece_chars):
        ids += enc.encode_ordinary(piece)
    return ids


def _mapped(df: DataFrame, source: str, outs: list[T.StructField], f: Callable) -> DataFrame:
    """``df`` with the columns ``outs`` made from batches of ``source``; columns of those names in ``df`` give way."""
    names = [x.name for x in outs]
    kept = df.drop(*[c for c in names if c in df.columns and c != source])
    schema = T.StructType([*kept.schema.fields, *outs])

    def run(batches):
        for b in batches:
            col = b.column(b.schema.get_field_index(source))
            yield pa.RecordBatch.from_arrays([*b.columns, *f(col)], names=[*b.schema.names, *names])

    return kept.mapInArrow(run, schema)


def encode(df: DataFrame, text: str = "text", out: str = "token_ids", rank_file: str | None = None, pattern: str | None = None, piece_chars: int = 65536) -> DataFrame:
    """Adds ``out``, the token ids of ``text`` (array of int).

    Null and empty texts give an empty array; rows, ties and further columns pass through; special tokens are ordinary
    text. Long texts are cut at safe boundaries, so their ids equal those of the whole text. An empty table gives none.
    """
    ids = _encoder(load_ranks(rank_file), pattern or default_pattern(), piece_chars)
    return _mapped(df, text, [T.StructField(out, T.ArrayType(T.IntegerType()))], lambda col: [ids(col)])


def _encoder(ranks: bytes, pattern: str, piece_chars: int) -> Callable:
    def ids(col):
        enc = encoding(ranks, pattern)
        flat, ends = array("i"), [0]
        for t in col.to_pylist():
            if t:
                flat.extend(encode_text(enc, t, piece_chars))
            ends.append(len(flat))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(flat, np.int32) if flat else [], pa.int32()))

    return ids


def _decoder(ranks: bytes, pattern: str) -> Callable:
    def raw(col):
        enc = encoding(ranks, pattern)
        flat = col.flatten().to_numpy(zero_copy_only=False)
        ends, at, got = col.value_lengths().fill_null(0).to_pylist(), 0, []
        for n in ends:
            got.append(enc.decode_bytes(flat[at : at + n].tolist()))
            at += n
        return pa.array(got, pa.binary())

    return raw


def decode(df: DataFrame, ids: str = "token_ids", out: str = "decoded", rank_file: str | None = None, pattern: str | None = None) -> DataFrame:
    """Adds ``out``, the raw bytes of the ids (binary, as ids may cut a character). Null ids give empty bytes; an empty
    table gives none."""
    raw = _decoder(load_ranks(rank_file), pattern or default_pattern())
    return _mapped(df, ids, [T.StructField(out, T.BinaryType())], lambda col: [raw(col)])


def transcode(df: DataFrame, text: str = "text", ids: str = "token_ids", out: str = "decoded", rank_file: str | None = None, pattern: str | None = None, piece_chars: int = 65536) -> DataFrame:
    """decode(encode(df)) in one pass, which takes half the Python workers."""
    ranks, pat = load_ranks(rank_file), pattern or default_pattern()
    coded, raw = _encoder(ranks, pat, piece_chars), _decoder(ranks, pat)

    def both(col):
        x = coded(col)
        return [x, raw(x)]

    return _mapped(df, text, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.BinaryType())], both)


def digests(df: DataFrame, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 in place of the ids and bytes."""
    return df.select(
        *[c for c in df.columns if c not in (ids, decoded)],
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col(ids).cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded), 256).alias("decoded_sha256"),
    )


def op9_byte_bpe(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(transcode(docs).drop("text"))


QUERIES = {"op9_byte_bpe": op9_byte_bpe}
SQL: dict[str, str] = {}
