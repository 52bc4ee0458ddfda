"""Shared pieces of the training-data operators: shared-folder tables, word hashing and batch helpers."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE = r"[\x20\x09-\x0D]+"

_own_dir: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="screenloom-")
    return _own_dir[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may be gone already; the folder is then left to its owner
        pass


@atexit.register
def _remove_all() -> None:
    for spark, path in _written:
        if spark.sparkContext._jsc is not None:
            _remove(spark, path)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: it cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, needed: DataFrame) -> None:
    """Removes the tables that ``written`` made in this session, but for those that ``needed`` reads."""
    used = {x.rsplit("/", 2)[-2] for x in needed.inputFiles()}
    for s, path in list(_written):
        if s is spark and path.rsplit("/", 1)[-1] not in used:
            _remove(s, path)
            _written.remove((s, path))


def forget(table: DataFrame) -> None:
    """Removes the table that ``written`` gave; nothing may read it any more."""
    used = {x.rsplit("/", 2)[-2] for x in table.inputFiles()}
    for s, path in list(_written):
        if s is table.sparkSession and path.rsplit("/", 1)[-1] in used:
            _remove(s, path)
            _written.remove((s, path))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """From now on at most ``rows`` rows go to Python at a time: whole texts are long, and what a batch takes is held on
    both sides."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def drop_shuffles(spark: SparkSession) -> None:
    """From now on a query's shuffle files go when it has ended, and not when the driver happens to collect its garbage."""
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def integer_keys(df: DataFrame, key: str) -> None:
    """An error unless the column ``key`` holds integers: another key cast to a number would be null and lost in silence."""
    kind = df.schema[key].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long"):
        raise TypeError(f"the key {key} has to be an integer column; it is {kind}")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_of(c: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+``; none for a null text."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE), lambda w: w != "")


def chunks(texts: Iterable[bytes | None], most: int = 1 << 20) -> Iterator[tuple[int, int, list[bytes]]]:
    """(from, to, texts) with about ``most`` bytes together; a longer text comes alone and whole. Null is empty."""
    start, held, size = 0, [], 0
    for t in texts:
        t = t or b""
        if held and size + len(t) > most:
            yield start, start + len(held), held
            start, held, size = start + len(held), [], 0
        held.append(t)
        size += len(t)
    if held:
        yield start, start + len(held), held


class WordHash(dict):
    """Word -> XXH64 as int, kept for the words of a task; emptied when it grows beyond ``most`` words."""

    def __init__(self, seed: int, most: int = 200_000):
        super().__init__()
        import xxhash

        self.hash, self.seed, self.most = xxhash.xxh64_intdigest, seed, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = self.hash(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser over uint64: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n; ``base`` is odd."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, np.uint64(b), np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _powers[base] = (out[0], out[1])
    up, down = _powers[base]
    return up[:n], down[:n]


class Rolling:
    """Polynomial hashes of any run of a sequence of word hashes, modulo 2**64."""

    def __init__(self, h: np.ndarray, base: int):
        up, self.down = powers(base, len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def at(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        n = len(self.sums) - width
        return mix((self.sums[width:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, np.uint64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
