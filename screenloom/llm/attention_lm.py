"""Scores of texts by a causal self-attention model over subword ids, trained in numpy, beside a unigram base.

Texts are split in blocks of a bounded size, written once: each has its distinct words, their training counts and subword
ids, and its documents as places in that list. So words meet their corpus counts once a block and not once a document,
and words are cut into subwords once a block.

The output is a mixture of EXPERTS softmaxes over the subword ids. Its weights come from masked attention over the WINDOW
subword ids before a word, of which those before the text's start are masked; windows of neighbouring words overlap. Each
expert gives a word's next subword after the one before it, and its end; so each subword, and each text's end, is scored
once, and what the experts say of a word is needed once a block, not once a place. Words seen in training mix that with
their share of the corpus, split among the experts by Bayes' rule; unseen words have their spelling alone.

Experts are clusters of documents by a random projection of their subwords. The attention starts as the naive Bayes rule for them and is trained by synchronous steps,
each over the whole of one of ROUNDS slices of the training texts (by a hash of the key): a step's gradient is summed over
all tasks, so the scores don't depend on how rows are dealt out, and every training text is used once.
"""

from __future__ import annotations

import copy
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import chunks, integer_keys, written
from .byte_bpe import default_pattern, encoding, load_ranks

#: Subwords are the vocabulary's first ranks; then the end of a text (or word), then what stands before its start.
SUBWORDS = 1022
END, START = SUBWORDS, SUBWORDS + 1
VOCAB, EXPERTS = SUBWORDS + 2, 8
WINDOW, DIM, HIDDEN = 16, EXPERTS, 16
#: Slices of the training texts, one a training step; slice 0 of a block are its held-out texts.
ROUNDS = 8
#: Numbers of a text's vector, by which texts are clustered.
SKETCH = 16
#: Words of a block's texts that are worked on at a time, since each takes numbers of its own beside those of the list.
PART = 1 << 17
#: Share of words of one subword among unseen words.
SHORT = 0.02
LN10 = np.log(10.0)


def held_out(key) -> bool:
    """crc32 of the key as text, modulo 5, is 1."""
    return zlib.crc32(str(int(key)).encode()) % 5 == 1


def slice_of(key) -> int:
    """0 for held-out and null keys, else the training step that uses the text, from 1."""
    return 0 if key is None or held_out(key) else 1 + zlib.crc32(str(int(key)).encode()) // 5 % ROUNDS


def packed(x: np.ndarray) -> bytes:
    """An int32 array, byte by byte of rising weight and compressed: small numbers take little room."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes())


def unpacked(raw: bytes) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def cut(enc, words: list[bytes], some: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """(subwords of all words, number of each). A word's are those of its bytes after a space; bytes that are no UTF-8 go as
    replacement characters. Words go to the encoder many at a time, a line each, where lines stay apart."""
    line, ids, sizes = enc.encode_ordinary("\n"), [], []
    for at in range(0, len(words), some):
        names = [w.decode("utf-8", "replace") for w in words[at : at + some]]
        got = np.array(enc.encode_ordinary(" " + "\n ".join(names) + "\n"), np.int64)
        ends = np.flatnonzero(got == line[0])
        if len(ends) == len(names) and len(line) == 1:
            ids.append(np.delete(got, ends))
            sizes.append(np.diff(ends, prepend=-1) - 1)
        else:  # a word with white space of its own at its end
            each = [enc.encode_ordinary(" " + w) for w in names]
            ids.append(np.array([x for y in each for x in y], np.int64))
            sizes.append(np.array(list(map(len, each)), np.int64))
    return (np.concatenate(ids), np.concatenate(sizes)) if ids else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _blocks(docs: DataFrame, ranks: bytes, pattern: str, block_bytes: int) -> DataFrame:
    """One row a block: its keys and text sizes by slice, words' hashes, training counts, subwords, and the texts' words."""

    def block(keys: list, texts: list[bytes]) -> dict:
        import xxhash

        enc = encoding(ranks, pattern, SUBWORDS)
        slices = np.array([slice_of(k) for k in keys], np.int16)
        order = np.argsort(slices, kind="stable")
        keys, slices = [keys[i] for i in order], slices[order]
        # Words without an object each: split at ASCII white space, then numbered.
        parts = pc.ascii_split_whitespace(pa.array([texts[i] for i in order.tolist()], pa.binary()).view(pa.string()))
        full = pc.greater(pc.binary_length(parts.flatten()), 0)
        sizes = np.bincount(pc.list_parent_indices(parts).filter(full).to_numpy(), minlength=len(keys))
        distinct = parts.flatten().filter(full).dictionary_encode()
        at, names = distinct.indices.to_numpy().astype(np.int32), distinct.dictionary.view(pa.binary()).to_pylist()
        del parts, full, distinct
        own = np.repeat(slices, sizes)
        subs, sub_sizes = cut(enc, names)
        return {
            "block": uuid.uuid4().int >> 65,
            "keys": np.array([-1 if k is None else int(k) for k in keys], np.int64).tobytes(),
            "nulls": np.array([k is None for k in keys], bool).tobytes(),
            "sizes": np.array(sizes, np.int32).tobytes(),
            "slices": slices.tobytes(),
            "sketch": sketches(subs[np.cumsum(sub_sizes) - sub_sizes][at] if len(at) else at, sizes).tobytes(),
            "sub_sizes": sub_sizes.astype(np.int32).tobytes(),
            "subs": subs.astype(np.int16).tobytes(),
            "words": np.array([xxhash.xxh64_intdigest(w, 3) for w in names], np.uint64).view(np.int64),
            "counts": np.bincount(at[own > 0], minlength=len(names)).astype(np.int32),
            "train_texts": int((slices > 0).sum()),
            **{f"at{r}": packed(at[own == r]) for r in range(ROUNDS + 1)},
        }

    def run(batches):
        for pdf in batches:
            keys = [None if pd.isna(k) else int(k) for k in pdf["key"].tolist()]
            for lo, hi, texts in chunks(pdf["text"], block_bytes):
                yield pd.DataFrame([block(keys[lo:hi], texts)])

    return docs.mapInPandas(run, "block long, keys binary, nulls binary, sizes binary, slices binary, sketch binary, sub_sizes binary, subs binary, words array<long>, counts array<int>, train_texts long, " + ", ".join(f"at{r} binary" for r in range(ROUNDS + 1)))


def _columns(slices: range) -> list[str]:
    return ["sizes", "slices", "sub_sizes", "subs", *[f"at{r}" for r in slices]]


#: The columns of the training texts.
_TRAIN = range(1, ROUNDS + 1)


class Block:
    """A block's arrays, of its texts in ``slices``: sizes in words, and the words' places in the block's list."""

    def __init__(self, row: dict, slices: range = range(ROUNDS + 1)):
        of = np.frombuffer(row["slices"], np.int16)
        self.texts = np.flatnonzero((of >= slices.start) & (of < slices.stop))
        self.sizes = np.frombuffer(row["sizes"], np.int32).astype(np.int64)[self.texts]
        self.at = np.concatenate([unpacked(row[f"at{r}"]) for r in slices])
        self.subs, self.lens = np.frombuffer(row["subs"], np.int16), np.frombuffer(row["sub_sizes"], np.int32).astype(np.int64)
        self.starts = np.cumsum(self.lens) - self.lens

    def used(self) -> tuple[np.ndarray, np.ndarray]:
        """(the list's words that these texts have, the place among those of each of the list; at -1, their number)."""
        seen = np.zeros(len(self.lens) + 1, bool)
        seen[self.at] = True
        words = np.flatnonzero(seen)
        return words, np.append(np.cumsum(seen[:-1]) - 1, len(words))

    def parts(self, most: int) -> Iterator[tuple[int, int, Block]]:
        """(from, to, a block of these texts) with about ``most`` words together; a longer text comes alone and whole."""
        ends, lo = np.cumsum(self.sizes), 0
        while lo < len(self.sizes):
            first = ends[lo] - self.sizes[lo]
            hi = max(lo + 1, int(np.searchsorted(ends, first + most, "right")))
            part = copy.copy(self)
            part.texts, part.sizes, part.at = self.texts[lo:hi], self.sizes[lo:hi], self.at[first : ends[hi - 1]]
            yield lo, hi, part
            lo = hi

    def spelled(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(subwords and an END for each of ``words``, what stands before each, words' lengths with the end, is single).

        Before the first is START; a word of one subword has END before it and has no end of its own.
        """
        n = self.lens[words]
        single = n == 1
        m = n + ~single
        first = np.cumsum(m) - m
        of = np.repeat(np.arange(len(words)), m)
        k = np.arange(m.sum()) - first[of]
        last = k == n[of]
        seq = np.where(last, END, np.append(self.subs, END)[self.starts[words][of] + k].astype(np.int64))
        before = np.roll(seq, 1)
        before[first] = np.where(single, END, START)
        return seq, before, m, single

    def targets(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(flat ids, WINDOW of START before each text; for each target, where it starts there; its word, -1 for an end).

        Targets are the words of each text and its end.
        """
        n_docs = len(self.sizes)
        if not n_docs:
            return np.full(WINDOW, START, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        ends = np.cumsum(self.sizes)
        lens = np.append(self.lens, [1, WINDOW])  # an end, and what stands before a text
        subs = np.concatenate([self.subs, [END], np.full(WINDOW, START, np.int16)])
        starts = np.cumsum(lens) - lens
        end, start = len(self.lens), len(self.lens) + 1
        seq = np.insert(self.at.astype(np.int64), np.repeat(np.concatenate([[0], ends]), np.concatenate([[1], np.full(n_docs - 1, 2), [1]])), np.tile([start, end], n_docs))
        n = lens[seq]
        places = np.cumsum(n) - n
        flat = subs[np.repeat(starts[seq] - places, n) + np.arange(n.sum())].astype(np.int32)
        real = seq != start
        return flat, places[real], np.where(seq[real] == end, -1, seq[real])


def windows(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    """(WINDOW, targets) ids before each target, the nearest first."""
    return flat[places[None, :] - 1 - np.arange(WINDOW)[:, None]]


def _summed(blocks: DataFrame, run, size: int) -> np.ndarray:
    """Sums (k, n) by k: made in each task and then by Spark; ``size`` numbers at most come to the driver."""
    got = blocks.mapInPandas(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(size)
    out[got["k"].to_numpy(np.int64)] = got["n"].to_numpy()
    return out


def _rows(held: np.ndarray) -> pd.DataFrame:
    at = np.flatnonzero(held)
    return pd.DataFrame({"k": at, "n": held[at].astype(float)})


def sketches(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, SKETCH) unit vectors: a random projection of how often each subword is the first of a word."""
    signs = np.random.default_rng(11).choice(np.array([-1, 1], np.float32), (SKETCH, VOCAB))
    out = np.zeros((len(sizes), SKETCH), np.float32)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        for d, s in enumerate(signs):
            out[full, d] = np.add.reduceat(s[first], starts)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _sketch(row: dict) -> np.ndarray:
    """Sketches of a block's training texts with words."""
    use = (np.frombuffer(row["slices"], np.int16) > 0) & (np.frombuffer(row["sizes"], np.int32) > 0)
    return np.frombuffer(row["sketch"], np.float32).reshape(-1, SKETCH)[use]


def nearest(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(v @ centres.T - (centres**2).sum(1) / 2, axis=1)


def clusters(blocks: DataFrame, steps: int = 4, seeds: int = 512) -> np.ndarray:
    """(EXPERTS, SKETCH) centres of the training texts' sketches: ``steps`` of Lloyd's over all texts, from centres that are
    spread over the ``seeds`` texts whose sketches have the smallest hash."""
    small = blocks.select("slices", "sizes", "sketch")

    def rows(batches):
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x = _sketch(row)
                if len(x):
                    yield pd.DataFrame({"hash": [zlib.crc32(v.tobytes()) for v in x], "v": [v.tobytes() for v in x]})

    first = small.mapInPandas(rows, "hash long, v binary").distinct().orderBy("hash", "v").limit(seeds).toPandas()
    v = np.frombuffer(b"".join(first["v"]), np.float32).reshape(-1, SKETCH).astype(float)
    if not len(v):
        return np.zeros((EXPERTS, SKETCH))
    rng, centres = np.random.default_rng(3), v[:1]
    while len(centres) < EXPERTS:
        far = ((v[:, None] - centres[None]) ** 2).sum(2).min(1)
        centres = np.vstack([centres, v[rng.choice(len(v), p=far / far.sum())] if far.sum() > 1e-9 else v[0]])
    for _ in range(20):
        near = nearest(v, centres)
        centres = np.array([v[near == k].mean(0) if (near == k).any() else centres[k] for k in range(EXPERTS)])
    for _ in range(steps):

        def run(batches, now=centres):
            held = np.zeros((EXPERTS, SKETCH + 1))
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    x = _sketch(row).astype(float)
                    near = nearest(x, now)
                    for k in range(EXPERTS):
                        held[k, :SKETCH] += x[near == k].sum(0)
                    held[:, SKETCH] += np.bincount(near, minlength=EXPERTS)
            yield pd.DataFrame({"k": np.arange(held.size), "n": held.ravel()})

        got = _summed(small, run, EXPERTS * (SKETCH + 1)).reshape(EXPERTS, SKETCH + 1)
        centres = np.where(got[:, SKETCH:] > 0, got[:, :SKETCH] / np.maximum(got[:, SKETCH:], 1), centres)
    return centres


class Experts:
    """Softmaxes over the next subword of a word: ``logs`` (EXPERTS, before, next), natural; ``short``: of their training
    words, the share of those of one subword; ``shares``: of all training words, theirs; ``use``: how often each subword is theirs."""

    def __init__(self, counts: np.ndarray, prior: float = 16.0):
        pairs = counts.reshape(EXPERTS, VOCAB, VOCAB)
        pool = pairs.sum(0)
        uni = pool.sum(0) + 0.5
        pool = (pool + 4 * uni / uni.sum()) / (pool.sum(1, keepdims=True) + 4)
        self.logs = np.empty((EXPERTS, VOCAB, VOCAB), np.float32)
        for k, c in enumerate(pairs):
            self.logs[k] = np.log((c + prior * pool) / (c.sum(1, keepdims=True) + prior))
        one, many = pairs[:, END].sum(1), pairs[:, START].sum(1)
        self.short = (one + 0.5) / (one + many + 1)
        self.shares = (one + many + 1) / (one + many + 1).sum()
        self.use = pairs.sum(1)

    def word_logs(self, b: Block, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(EXPERTS, words) natural logs of each word's probability: as one of training's, and as an unseen one."""
        if not len(words):
            return np.zeros((EXPERTS, 0)), np.zeros((EXPERTS, 0))
        seq, before, m, single = b.spelled(words)
        at = before * VOCAB + seq
        first = np.cumsum(m) - m
        inside = np.stack([np.add.reduceat(x.ravel()[at], first, dtype=np.float64) for x in self.logs])
        own = np.where(single, np.log(self.short)[:, None], np.log1p(-self.short)[:, None])
        return inside + own, inside + np.where(single, np.log(SHORT), np.log1p(-SHORT))

    def posterior(self, logs: np.ndarray) -> np.ndarray:
        """(EXPERTS, words) chance that a training word is the expert's."""
        x = logs + np.log(self.shares)[:, None]
        x = np.exp(x - x.max(0))
        return x / x.sum(0)


def expert_counts(blocks: DataFrame, centres: np.ndarray) -> np.ndarray:
    """(expert, before, next) counts in the words of the training texts; a text is that of the nearest centre's expert.
    EXPERTS * VOCAB**2 numbers at most, whatever the corpus."""

    def run(batches):
        held = np.zeros(EXPERTS * VOCAB * VOCAB)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row, _TRAIN)
                sketch = np.frombuffer(row["sketch"], np.float32).reshape(-1, SKETCH)[b.texts]
                n = np.zeros((EXPERTS, max(len(b.lens), 1)), np.int64)
                for lo, hi, part in b.parts(PART):
                    # A word once a text: names and frequent words say little of how others are spelled.
                    pair = np.sort(np.repeat(np.arange(hi - lo), part.sizes) * n.shape[1] + part.at)
                    pair = pair[np.append(True, pair[1:] != pair[:-1])] if len(pair) else pair
                    n += np.bincount(nearest(sketch[lo:hi], centres)[pair // n.shape[1]] * n.shape[1] + pair % n.shape[1], minlength=n.size).reshape(n.shape)
                for k in range(EXPERTS):
                    words = np.flatnonzero(n[k])
                    seq, before, m, _ = b.spelled(words)
                    held[k * VOCAB * VOCAB : (k + 1) * VOCAB * VOCAB] += np.bincount(before * VOCAB + seq, weights=np.repeat(n[k, words], m), minlength=VOCAB * VOCAB)
        yield _rows(held)

    return _summed(blocks.select("sketch", *_columns(_TRAIN)), run, EXPERTS * VOCAB * VOCAB)


def _some(words: np.ndarray, most: int = 1 << 15) -> Iterator[np.ndarray]:
    """At most ``most`` of the words at a time, since a word takes several numbers for each expert."""
    for at in range(0, len(words), most):
        yield words[at : at + most]


def expert_tokens(blocks: DataFrame, experts) -> np.ndarray:
    """Training words of each expert, each split by Bayes' rule."""

    def run(batches):
        total = np.zeros(EXPERTS)
        for pdf in batches:
            for row in pdf.to_dict("records"):
                b = Block(row | {f"at{r}": _NONE for r in range(ROUNDS + 1)})
                n = np.asarray(row["counts"], float)
                for words in _some(np.flatnonzero(n)):
                    total += experts.value.posterior(experts.value.word_logs(b, words)[0]) @ n[words]
        yield pd.DataFrame({"k": np.arange(EXPERTS), "n": total})

    return _summed(blocks.select("sizes", "slices", "sub_sizes", "subs", "counts"), run, EXPERTS)


_NONE = packed(np.zeros(0, np.int32))
#: Trained weights; the embedding "e" beside them comes from the experts' counts.
_SHAPES = {"pos": (WINDOW, DIM), "q": (DIM, DIM), "k": (DIM, DIM), "b": (1, DIM), "v": (DIM, DIM), "w1": (DIM, HIDDEN), "w2": (DIM, HIDDEN), "o": (HIDDEN, EXPERTS + 1), "g": (DIM, EXPERTS + 1), "ob": (1, EXPERTS + 1)}
_PLACES = np.cumsum([0, *[int(np.prod(s)) for s in _SHAPES.values()]])


def start_weights(use: np.ndarray, shares: np.ndarray, gain: float = 4.0, seed: int = 1) -> dict[str, np.ndarray]:
    """The naive Bayes rule: a subword's values are how much more likely it is under each expert, the attention is even,
    and the bias is the log share of each expert (and of ends). ``gain``: how many independent subwords a window counts as."""
    rng = np.random.default_rng(seed)
    w = {k: (rng.standard_normal(s) * 0.1 * s[0] ** -0.5).astype(np.float32) for k, s in _SHAPES.items()}
    p = (use + 8 * (use.sum(0) + 0.1) / (use.sum() + 0.1 * VOCAB)) / (use.sum(1, keepdims=True) + 8)
    all_ = (use.sum(0) + 0.1) / (use.sum() + 0.1 * VOCAB)
    e = np.clip(np.log(p / all_), -4, 4).T
    w["e"] = (e - e.mean(1, keepdims=True)).astype(np.float32)
    w["e"][[END, START]] = 0
    w["v"] = np.eye(DIM, dtype=np.float32)
    w["g"] = np.hstack([gain * np.eye(EXPERTS), np.zeros((DIM, 1))]).astype(np.float32)
    w["b"] *= 0
    w["ob"] = np.log(shares)[None].astype(np.float32)
    return w


def pair_scores(w: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query of each subword, attention score of each nearest subword and any subword, score of it and each place): with
    so small a vocabulary, products are looked up and not made at each place."""
    q = w["e"] @ w["q"] * w["e"].dtype.type(DIM**-0.5) + w["b"]
    return q, q @ (w["e"] @ w["k"]).T, w["pos"] @ w["k"] @ q.T


def forward(w: dict, ids: np.ndarray, scores: tuple):
    """(ln weight of each expert, and of an end (n, EXPERTS + 1), what the gradient needs) for windows ``ids`` (WINDOW, n).

    Causal: a window holds only what stands before its target. Places before the text's start are masked, but for the
    nearest, and what is attended to counts by the share of places that aren't. ``scores``: pair_scores of ``w``.
    """
    _, pairs, places = scores
    e = np.take(w["e"], ids, axis=0, mode="clip")
    masked = ids == START
    real = (1 - masked.mean(0)).astype(e.dtype)[:, None]
    a = np.take(pairs.ravel(), ids[0].astype(np.int64) * VOCAB + ids)
    a += np.take(places, ids[0], axis=1)
    a[1:][masked[1:]] = -1e9
    a -= a.max(0)
    np.exp(a, out=a)
    a /= a.sum(0)
    c = (e * a[:, :, None]).sum(0) * real
    y = c @ w["v"]
    h = np.maximum(e[0] @ w["w1"] + y @ w["w2"], 0)
    z = h @ w["o"]
    z += y @ w["g"]
    z += w["ob"]
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z, (e, a, c, y, h, real)


def gradient(w: dict, ids: np.ndarray, likely: np.ndarray, scores: tuple) -> dict[str, np.ndarray]:
    """Of the summed log loss of the targets, but for the embedding. ``likely`` (n, EXPERTS + 1): what each expert, and the
    end, gives the target, up to a factor of the target's own."""
    z, (e, a, c, y, h, real) = forward(w, ids, scores)
    x, q, scale = e[0], scores[0][ids[0]], e.dtype.type(DIM**-0.5)
    dz = np.exp(z)
    post = dz * likely
    dz -= post / np.maximum(post.sum(1, keepdims=True), 1e-30)
    dh = (dz @ w["o"].T) * (h > 0)
    dy = dh @ w["w2"].T + dz @ w["g"].T
    g = {"o": h.T @ dz, "g": y.T @ dz, "ob": dz.sum(0, keepdims=True), "w1": x.T @ dh, "w2": y.T @ dh, "v": c.T @ dy}
    da = ((e * (dy @ w["v"].T * real)).reshape(-1, DIM) @ np.ones(DIM, e.dtype)).reshape(a.shape)
    ds = a * (da - np.einsum("wn,wn->n", da, a))
    er, near = (e * ds[:, :, None]).sum(0), ds @ q  # by subword and by place
    dq = er @ w["k"] + ds.T @ (w["pos"] @ w["k"])
    g["k"], g["pos"] = er.T @ q + w["pos"].T @ near, near @ w["k"].T
    g["b"], g["q"] = dq.sum(0, keepdims=True), x.T @ dq * scale
    return g


class Adam:
    def __init__(self, w: dict, rate: float = 0.05):
        self.w, self.rate, self.n = w, rate, 0
        self.m = {k: np.zeros_like(w[k]) for k in _SHAPES}
        self.v = {k: np.zeros_like(w[k]) for k in _SHAPES}

    def step(self, g: dict) -> None:
        self.n += 1
        rate = self.rate * (1 - self.n / (ROUNDS + 4)) * (1 - 0.95**self.n) ** 0.5 / (1 - 0.8**self.n)
        for k, x in g.items():
            x = x.astype(self.m[k].dtype)
            self.m[k] += 0.2 * (x - self.m[k])
            self.v[k] += 0.05 * (x * x - self.v[k])
            self.w[k] -= np.float32(rate) * self.m[k] / (np.sqrt(self.v[k]) + np.float32(1e-5))


def with_end(per_word: np.ndarray) -> np.ndarray:
    """(words + 1, EXPERTS + 1): a word's column of ``per_word`` and no end; the last row is the end's alone."""
    wide = np.zeros((per_word.shape[1] + 1, EXPERTS + 1), np.float32)
    wide[:-1, :EXPERTS] = per_word.T
    wide[-1, EXPERTS] = 1
    return wide


def train(blocks: DataFrame, experts, tokens: np.ndarray, ends: int, batch: int = 4096) -> dict[str, np.ndarray]:
    """Weights after a step for each slice of the training texts."""
    shares = np.append(tokens, ends) + 0.5
    w = start_weights(experts.value.use, shares / shares.sum())
    adam = Adam(w)
    for r in range(1, ROUNDS + 1):
        now = {k: x.copy() for k, x in w.items()}

        def run(batches, r=r, now=now):
            total, n, scores = np.zeros(_PLACES[-1]), 0, pair_scores(now)
            for pdf in batches:
                for row in pdf.to_dict("records"):
                    b = Block(row, range(r, r + 1))
                    words, place = b.used()
                    share = with_end(experts.value.posterior(experts.value.word_logs(b, words)[0]) / np.maximum(tokens, 1e-9)[:, None] * tokens.sum())
                    flat, places, goal = b.targets()
                    goal = place[goal]
                    for at in range(0, len(places), batch):
                        g = gradient(now, windows(flat, places[at : at + batch]), share[goal[at : at + batch]], scores)
                        total += np.concatenate([g[k].ravel() for k in _SHAPES])
                    n += len(places)
            if n:
                yield pd.DataFrame({"k": np.arange(-1, len(total)), "n": np.append(n, total)})

        got = blocks.select(*_columns(range(r, r + 1))).mapInPandas(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
        if len(got):
            flat = np.zeros(_PLACES[-1] + 1)
            flat[got["k"].to_numpy(np.int64) + 1] = got["n"].to_numpy()
            adam.step({k: (flat[1:][a:b] / flat[0]).reshape(s) for (k, s), a, b in zip(_SHAPES.items(), _PLACES[:-1], _PLACES[1:], strict=True)})
    return w


def target_scores(w: dict, flat: np.ndarray, places: np.ndarray, goal: np.ndarray, per_word: np.ndarray, some: int = 4096) -> np.ndarray:
    """ln probability of each target. ``per_word``: (EXPERTS, words) ln probabilities."""
    return _scored(w, flat, places, goal, *_scaled(per_word), pair_scores(w), some)


def _scaled(per_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what each expert gives a word, and the end, by the most that one gives; the ln of that)."""
    top = per_word.max(0) if per_word.size else np.zeros(per_word.shape[1])
    return with_end(np.exp(per_word - top)), np.append(top, 0.0)


def _scored(w: dict, flat: np.ndarray, places: np.ndarray, goal: np.ndarray, share: np.ndarray, top: np.ndarray, scores: tuple, some: int = 4096) -> np.ndarray:
    out = np.zeros(len(places))
    for at in range(0, len(places), some):
        z, _ = forward(w, windows(flat, places[at : at + some]), scores)
        own = goal[at : at + some]
        out[at : at + some] = np.log(np.einsum("nk,nk->n", np.exp(z), share[own]) + 1e-38) + top[own]
    return out


def word_scores(experts: Experts, b: Block, c: np.ndarray, tokens: np.ndarray, unseen: float) -> np.ndarray:
    """(EXPERTS, words) ln probabilities of the list's words, of corpus counts ``c``: of seen words, their share of each
    expert's training words; of all, what is left for the ``unseen``, spelled."""
    out = np.empty((EXPERTS, len(b.lens)))
    for words in _some(np.arange(len(b.lens))):
        logs, spelling = experts.word_logs(b, words)
        share = np.log(np.maximum(experts.posterior(logs), 1e-30)) + np.log(np.maximum(c[words], 1e-30)) - np.log(np.maximum(tokens, 1e-9))[:, None] + np.log1p(-unseen)
        out[:, words] = np.logaddexp(share, spelling + np.log(unseen))
    return out


def text_scores(w: dict, b: Block, c: np.ndarray, per_word: np.ndarray, most: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text of ``b``: the sum of log10(c + 0.5) over its words, how many of these have a count, and its ln
    probability with its end. What a word takes in its text is held for about ``most`` words at a time."""
    base, known, own = (np.zeros(len(b.sizes)) for _ in range(3))
    logs, seen, scores = np.log10(c + 0.5), c > 0, pair_scores(w)
    share, top = _scaled(per_word)
    for lo, hi, part in b.parts(most):
        of = np.repeat(np.arange(hi - lo), part.sizes)
        base[lo:hi] = np.bincount(of, weights=logs[part.at], minlength=hi - lo)
        known[lo:hi] = np.bincount(of, weights=seen[part.at], minlength=hi - lo)
        of = np.repeat(np.arange(hi - lo), part.sizes + 1)
        own[lo:hi] = np.bincount(of, weights=_scored(w, *part.targets(), share, top, scores), minlength=hi - lo)
    return base, known.astype(np.int64), own


def corpus_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, i, c, n_tokens, n_words, n_once): for each block and bucket of word hashes, places in the block's list and the
    corpus counts of these words, as arrays; tokens, words with a count, and those with a count of 1, of a bucket in one of
    its rows. Words move as arrays, not as rows."""

    def dealt(batches):
        for pdf in batches:
            for block, words, counts in zip(pdf["block"], pdf["words"], pdf["counts"], strict=True):
                h, n = np.asarray(words, np.int64), np.asarray(counts, np.int32)
                own = h.view(np.uint64) % np.uint64(buckets)
                order = np.argsort(own, kind="stable").astype(np.int32)
                parts = np.split(order, np.searchsorted(own[order], np.arange(1, buckets, dtype=np.uint64)))
                full = [(k, x) for k, x in enumerate(parts) if len(x)]
                yield pd.DataFrame({"bucket": [k for k, _ in full], "block": block, "i": [x.tobytes() for _, x in full], "h": [h[x].tobytes() for _, x in full], "n": [n[x].tobytes() for _, x in full]})

    def summed(pdf):
        h, n = np.frombuffer(b"".join(pdf["h"]), np.int64), np.frombuffer(b"".join(pdf["n"]), np.int32)
        kinds, at = np.unique(h, return_inverse=True)
        c = np.bincount(at, weights=n, minlength=len(kinds)).astype(np.int64)
        ends = np.cumsum([len(x) // 8 for x in pdf["h"]])
        first = np.arange(len(pdf)) == 0
        each = [x.tobytes() for x in np.split(c[at], ends[:-1])]
        return pd.DataFrame({"block": pdf["block"], "i": pdf["i"], "c": each, "n_tokens": first * c.sum(), "n_words": first * (c > 0).sum(), "n_once": first * (c == 1).sum()})

    parts = blocks.select("block", "words", "counts").mapInPandas(dealt, "bucket int, block long, i binary, h binary, n binary")
    return parts.groupBy("bucket").applyInPandas(summed, "block long, i binary, c binary, n_tokens long, n_words long, n_once long")


def score(df: DataFrame, text: str = "text", key: str = "doc_id", rank_file: str | None = None, pattern: str | None = None, block_bytes: int = 12 << 20) -> DataFrame:
    """For each row of ``df``: key, held_out, n_tokens, n_known, train_tokens, base_score and score; no other columns.

    Trained on rows whose key isn't held out (see held_out); tokens are ASCII-white-space separated words, A-Z
    lower-cased, and one end. base_score is the unigram log10 probability with half a count for each token; score is
    the model's log10 probability of the same words and end: of all the subwords that spell them. Null and empty texts have only the end. Rows with null
    keys are scored as held out and not learnt from; keys are integers (else an error). Repeated rows each get a row and
    count each time. An empty table gives none. A very long text is whole in one block.
    """
    ranks, pat = load_ranks(rank_file), pattern or default_pattern()
    integer_keys(df, key)
    docs = df.select(F.col(key).cast("long").alias("key"), F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").cast("binary").alias("text"))
    blocks = written(_blocks(docs, ranks, pat, block_bytes), "blocks")
    found = blocks.agg(F.sum("train_texts"), F.count("*")).first()
    ends = int(found[0] or 0)
    known = written(corpus_counts(blocks, min(512, max(8, found[1] // 8))), "word-counts")
    total = known.agg(F.sum("n_tokens"), F.sum("n_words"), F.sum("n_once")).first()
    n_train, v = int(total[0] or 0) + ends, int(total[1] or 0) + (ends > 0)
    unseen = min(0.5, ((total[2] or 0) + 0.5) / (n_train + 1))  # the mass of unseen words, by Good and Turing
    experts = blocks.sparkSession.sparkContext.broadcast(Experts(expert_counts(blocks, clusters(blocks))))
    tokens = expert_tokens(blocks, experts)
    w = train(blocks, experts, tokens, ends)
    below = np.log10(n_train + 0.5 * (v + 1))

    def run(block, counts):
        out = []
        for row in block.to_dict("records"):
            b = Block(row)
            keys, nulls = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["nulls"], bool)
            c = np.zeros(len(b.lens))
            for i, n in zip(counts["i"], counts["c"], strict=True):
                c[np.frombuffer(i, np.int32)] = np.frombuffer(n, np.int64)
            base, n_known, each = text_scores(w, b, c, word_scores(experts.value, b, c, tokens, unseen))
            out.append(pd.DataFrame({
                "key": pd.array(np.where(nulls, 0, keys), "Int64"),
                "held_out": np.array([bool(n) or held_out(k) for k, n in zip(keys.tolist(), nulls.tolist(), strict=True)], bool),
                "n_tokens": b.sizes + 1,
                "n_known": n_known + (ends > 0),
                "train_tokens": n_train,
                "base_score": base + np.log10(ends + 0.5) - below * (b.sizes + 1),
                "score": each / LN10,
            }))
            out[-1].loc[nulls, "key"] = pd.NA
        return pd.concat(out) if out else pd.DataFrame(columns=["key", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    got = blocks.drop("words", "counts").groupBy("block").cogroup(known.select(F.col("block").alias("at_block"), "i", "c").groupBy("at_block")).applyInPandas(run, "key long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return got.withColumnRenamed("key", key)


def op5_attention_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op5_attention_lm": op5_attention_lm}
SQL: dict[str, str] = {}
