"""Image hashes, radius joins by bands and groups of duplicates."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def dct_hash(grey: np.ndarray, side: int = 8) -> int:
    """64 bits of a square grey image: which of its lowest ``side`` x ``side`` cosine terms are over their median."""
    n = len(grey)
    k = np.arange(side)[:, None] * (2 * np.arange(n)[None, :] + 1) * np.pi / (2 * n)
    low = np.cos(k) @ grey @ np.cos(k).T
    bits = (low > np.median(low)).ravel()
    value = int.from_bytes(np.packbits(bits).tobytes(), "big")
    return value - (1 << 64) if value >= 1 << 63 else value


def perceptual_hashes(df: DataFrame, key: str, pixels: str) -> DataFrame:
    """key and hash of square images given as arrays of grey values; rows without a square of pixels go."""

    def run(batches):
        for pdf in batches:
            out = []
            for k, p in zip(pdf[key], pdf[pixels], strict=True):
                side = int(round(len(p) ** 0.5)) if p is not None else 0
                if side >= 8 and side * side == len(p):
                    out.append((k, dct_hash(np.asarray(p, float).reshape(side, side))))
            yield pd.DataFrame(out, columns=["key", "hash"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, pixels).mapInPandas(run, f"key {kind}, hash bigint").withColumnRenamed("key", key)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


#: Fixed sizes: hashes of a bucket that one call compares, and pairs that are held at a time.
BLOCK, HELD = 1 << 16, 1 << 20


def _spread(n: int, radius: int) -> list[list[int]]:
    """The masks of 64 bits' ``n`` bands, each as ``radius`` + 1 masks: bits are dealt out in turn, so bits that never
    differ take a little from every band."""
    return [[sum(1 << i for i in range(64) if i % n == k and i // n % (radius + 1) == j) for j in range(radius + 1)] for k in range(n)]


def _packed(h: np.ndarray, mask: int) -> np.ndarray:
    """The bits of ``mask``, next to each other."""
    out = np.zeros(len(h), np.int64)
    for k, i in enumerate(i for i in range(64) if mask >> i & 1):
        out |= ((h >> np.uint64(i)) & np.uint64(1)).astype(np.int64) << k
    return out


def _near(a: np.ndarray, b: np.ndarray, free: list[int], errors: int, radius: int):
    """Hashes (x, y) of the pairs of ``a`` and ``b`` at most ``errors`` bits apart on the bits ``free`` and at most ``radius``
    in all, some at a time; if ``b`` is ``a``, each pair once. ``b`` is indexed by the free bits, and each of ``a`` looks up
    the values near its own."""
    mask, n, same = sum(1 << i for i in free), len(free), a is b
    if len(a) * len(b) <= HELD >> 3:
        i, j = np.triu_indices(len(a), 1) if same else (x.ravel() for x in np.indices((len(a), len(b))))
        ok = (np.bitwise_count((a[i] ^ b[j]) & np.uint64(mask)) <= errors) & (np.bitwise_count(a[i] ^ b[j]) <= radius)
        yield a[i[ok]], b[j[ok]]
        return

    def ordered(h):
        bits = _packed(h, mask)
        order = np.argsort(bits, kind="stable")
        return h[order], bits[order]

    (a, key_a), (b, key_b) = (ordered(a),) * 2 if same else (ordered(a), ordered(b))
    ends = np.concatenate([[0], np.cumsum(np.bincount(key_b, minlength=1 << n))])
    for flips in (sum(1 << i for i in c) for e in range(errors + 1) for c in itertools.combinations(range(n), e)):
        rows = np.flatnonzero(key_a & (1 << flips.bit_length() >> 1) == 0) if same and flips else np.arange(len(a))
        look = key_a[rows] ^ flips
        start = np.maximum(ends[look], rows + 1) if same and not flips else ends[look]
        size = ends[look + 1] - start
        total = np.cumsum(size)
        at = 0
        while at < len(rows):  # a slice has HELD pairs at most, or is one hash with a block
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + HELD, "right")))
            k = size[at:to]
            x = np.repeat(a[rows[at:to]], k)
            y = b[np.arange(len(x)) + np.repeat(start[at:to] - (np.cumsum(k) - k), k)]
            ok = np.bitwise_count(x ^ y) <= radius
            yield x[ok], y[ok]
            at = to


def within_radius(df: DataFrame, key: str, hash_: str = "hash", radius: int = 8) -> DataFrame:
    """Pairs (hash_a < hash_b, distance) of distinct hashes at most ``radius`` bits apart.

    Of n bands of bits with n * (e + 1) > ``radius``, one of two such hashes' differs in e bits at most, and so one of its
    e + 1 parts in none: hashes are dealt out by the (band, part, bits) that they have, and in a bucket those that also
    agree on the band's other bits, but for e of them, are looked up and compared. A pair counts in the first bucket that
    gives it. Buckets of over BLOCK hashes are dealt out as pairs of blocks. Rows of one hash meet before, so copies make
    no pairs.
    """
    e = 2 if radius >= 8 else 1 if radius >= 3 else 0
    n = radius // (e + 1) + 1
    masks = [m for band in _spread(n, e) for m in band]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    reps = _written(df.where(F.col(hash_).isNotNull()).select(F.col(hash_).alias("h")).distinct(), "hashes")
    rows = reps.select("h", F.posexplode(F.array(*[F.col("h").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("part", "bits"))
    # The few buckets that are larger than a block, if there are any: at most (e + 1) * n * reps / BLOCK rows.
    large = rows.groupBy("part", "bits").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("part", "bits", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    large = _written(large, "large")
    rows = rows.join(F.broadcast(large), ["part", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int")
    turn = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    rows = rows.withColumn("own", own).withColumn("other", turn).select("part", "bits", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "h")
    bucket = ["part", "bits", "lo", "hi"]

    def compared(part: int, lo: int, hi: int, own: np.ndarray, h: np.ndarray):
        band, done = part // (e + 1), [np.uint64(m) for m in masks[:part]]
        rest = [i for i in range(64) if i % n == band and not masks[part] >> i & 1]
        left, right = (h, h) if lo == hi else (h[own == lo], h[own == hi])
        for x, y in _near(left, right, rest, e, radius):
            v = x ^ y
            first = np.ones(len(x), bool)
            for q, m in enumerate(done):  # another bucket before gave the pair
                whole = np.uint64(sum(masks[q // (e + 1) * (e + 1) :][: e + 1]))
                first &= ~((v & m == 0) & (np.bitwise_count(v & whole) <= e))
            x, y, v = x[first].view(np.int64), y[first].view(np.int64), v[first]
            if len(x):
                yield pd.DataFrame({"hash_a": np.minimum(x, y), "hash_b": np.maximum(x, y), "distance": np.bitwise_count(v).astype(np.int32)})

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        now = None
        for pdf in batches:
            keys = pdf[bucket].to_numpy(np.int64)
            h, own = pdf["h"].to_numpy(np.int64).view(np.uint64), pdf["own"].to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(h)], strict=True):
                if a == b:
                    continue
                if held and tuple(keys[a]) != now:
                    yield from compared(now[0], now[2], now[3], *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                now = tuple(keys[a].tolist())
                held.append((own[a:b], h[a:b]))
        if held:
            yield from compared(now[0], now[2], now[3], *map(np.concatenate, zip(*held, strict=True)))

    return rows.repartition(*bucket).sortWithinPartitions(*bucket).mapInPandas(run, "hash_a bigint, hash_b bigint, distance int")


_own_dir: dict[str, str] = {}


def _written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` by way of a table in the shared folder, which cuts lineage and outlives executors."""
    spark: SparkSession = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if not found and app not in _own_dir:
        _own_dir[app] = "file://" + tempfile.mkdtemp(prefix="screenloom-")
    path = f"{(found or _own_dir[app]).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of ``links``: the smallest node that each reaches.

    Each round, nodes point to the smallest node among their neighbours' roots, and then to their root's root, until
    nothing changes: rounds grow with the logarithm of the longest chain.
    """
    edges = _written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).union(links.select(b, a)).where("a <> b").distinct(), "links")
    root = _written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    for _ in range(most_rounds):
        near = edges.join(root, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("m"))
        # Both the node and its root learn of the smaller root.
        offer = root.join(near, F.col("node") == F.col("a")).select("node", "root", F.least("root", "m").alias("m"))
        told = offer.select("node", "m").union(offer.select(F.col("root"), "m")).groupBy("node").agg(F.min("m").alias("m"))
        hop = told.select(F.col("node").alias("up"), F.col("m").alias("top"))
        new = _written(told.join(hop, F.col("m") == F.col("up"), "left").select("node", F.least("m", F.coalesce("top", "m")).alias("root")), "roots")
        changed = new.join(root.withColumnRenamed("root", "old"), "node", "left").where("old IS NULL OR root <> old").isEmpty()
        root = new
        if changed:
            return root.select("node", F.col("root").alias("component"))
    raise RuntimeError(f"more than {most_rounds} rounds")


def duplicate_groups(df: DataFrame, key: str, hash_: str = "hash", radius: int = 8) -> DataFrame:
    """key and group_id (its smallest hash's number in order) of rows in groups of two or more, linked within ``radius``.

    Groups are those of the links' connected components; equal hashes are in one group. Null hashes are in none.
    """
    found = connected(within_radius(df, key, hash_, radius), "hash_a", "hash_b")
    named = df.where(F.col(hash_).isNotNull()).join(found, F.col(hash_) == F.col("node"), "left").select(key, F.coalesce("component", hash_).alias("component"))
    sizes = named.groupBy("component").agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1").select("component", "first")
    return named.join(sizes, "component").select(key, F.col("first").alias("group_id"))


def keep_first(df: DataFrame, key: str, hash_: str = "hash", radius: int = 8) -> DataFrame:
    """The rows of ``df`` without those of a group whose key isn't its smallest."""
    gone = duplicate_groups(df, key, hash_, radius).where(F.col(key) != F.col("group_id")).select(key)
    return df.join(gone, key, "left_anti")
