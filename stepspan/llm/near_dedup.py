"""MinHash near-dedup with SetSketch registers.

Each text gives the set of its distinct 5-word shingles (64-bit hashes). SetSketch register i holds the exponentially
spaced, truncated minimum K_i = floor(1 - log_b(min h_i)) with h_i exponential of rate a; the larger the register the
smaller the minimum, so sketches of parts merge by maximum. Bands of registers give candidate pairs, a joint likelihood
of (greater, smaller, equal) registers drops the clearly different ones, and the full sets decide.

Texts with equal sets (equal 128-bit hashes of them) are one class, with an id of its own. The classes of a bucket meet in
rounds, through pivots (see pairs.py).

Nulls and edges: a null or wordless text has an empty set and is linked with nothing; a text of fewer than five words
is one shingle. A row with a null doc_id is linked with nothing: component_id null, kept true. Rows with one doc_id are
one node: all their links count for it. An empty table gives an empty result. Texts of any length are taken whole; a very
long one is one large set. Only doc_id and text are read, all other columns are ignored and may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import maybe_broadcast, small_batches, staged, unstage
from .components import connected_components
from .pairs import BROADCAST_ROWS, bucket_links, confirmed, shared_buckets

WORDS, PERCENT = 5, 75
#: Registers, registers a band, base and rate of the sketch. 32 bands of 5 miss a pair of similarity 0.75 once in 5,700.
M, ROWS, BASE, RATE = 160, 5, 1.001, 20.0
#: Pairs estimated this far below the limit are dropped: 4 standard errors of 160 registers.
MARGIN = 0.14

_random = np.random.default_rng(20)
_MULTIPLY = _random.integers(0, 2**32, M, dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 2**32, M, dtype=np.uint32)
_PLACES = _random.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes; remembers the hashes of words, within bounds."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes | None) -> np.ndarray:
        import xxhash

        words = (text or b"").lower().split()  # bytes: only A-Z, only ASCII white space
        known, digest = self.known, xxhash.xxh3_64_intdigest
        if len(known) > 300_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = digest(w)
        n = len(words)
        x = np.fromiter(map(known.__getitem__, words), np.uint64, n)
        if not n:
            return x
        k = min(n, WORDS)
        h = np.full(n - k + 1, k, np.uint64)
        for j in range(k):
            h += x[j : n - k + 1 + j] * _PLACES[j]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        return np.unique(h)


def registers(shingles: np.ndarray) -> np.ndarray:
    """The M registers of a non-empty set."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    least = np.full(M, 2**32 - 1, np.uint32)
    for i in range(0, len(x), 512):
        np.minimum(least, (x[i : i + 512, None] * _MULTIPLY + _ADD).min(0), out=least)
    e = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(e) / np.log(BASE)), 0, 65535).astype("<u2")


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    shingler, empty = Shingler(), bytes(2 * M)
    for batch in batches:
        sizes, low, high, sketches = [], [], [], []
        for i in range(0, batch.num_rows, 128):
            for text in batch.column(2).slice(i, 128).cast(pa.large_binary()).to_pylist():
                s = shingler(text)
                sizes.append(len(s))
                key = xxhash.xxh3_128_digest(s.tobytes())
                low.append(int.from_bytes(key[:8], "little", signed=True))
                high.append(int.from_bytes(key[8:], "little", signed=True))
                sketches.append(registers(s).tobytes() if len(s) else empty)
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(sketches, pa.binary())], names=["doc_id", "th", "n", "c", "c2", "regs"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shingler = Shingler()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            sets = [shingler(t).view(np.int64) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.record_batch([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["c", "shingles"])


def joint_similarity(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of pairs of sketches, given both sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = M - more - less
    u, v = na / (na + nb), nb / (na + nb)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        pu, pv = p(u - v * j), p(v - u * j)
        return more * np.log(pu) + less * np.log(pv) + same * np.log(np.clip(1 - pu - pv, 1e-12, 1))

    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood is concave
        x, y = lo + (hi - lo) / 3, hi - (hi - lo) / 3
        up = likelihood(x) < likelihood(y)
        lo, hi = np.where(up, x, lo), np.where(up, hi, y)
    return (lo + hi) / 2


@F.pandas_udf(DoubleType())
def _estimate(a: pd.Series, b: pd.Series, na: pd.Series, nb: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype="float64")
    x, y = (np.frombuffer(b"".join(map(bytes, s)), "<u2").reshape(-1, M).astype(np.int32) for s in (a, b))
    return pd.Series(joint_similarity(x, y, na.to_numpy(float), nb.to_numpy(float)))


def links(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """classes: (c, doc_id, th, n, regs), one row per distinct set; docs: (doc_id, th, text). -> (a, b), class ids."""
    band = F.explode(F.transform(F.sequence(F.lit(0), F.lit(M // ROWS - 1)), lambda i: F.xxhash64(F.substring("regs", i * 2 * ROWS + 1, F.lit(2 * ROWS)), i)))
    members = shared_buckets(classes.select("c", "n", band.alias("key")))
    wanted = staged(members.select("c").distinct().join(classes.select("c", "doc_id", "th"), "c"), "wanted")
    rows = docs.join(maybe_broadcast(wanted, wanted.count(), BROADCAST_ROWS), ["doc_id", "th"]).select("c", "text").mapInArrow(_sets, "c bigint, shingles array<bigint>")
    sets = staged(rows, "sets")  # repeated rows give equal sets
    ends = [classes.select(F.col("c").alias(x), F.col("n").alias(f"n{x}"), F.col("regs").alias(f"r{x}")) for x in "ab"]

    def verify(pairs: DataFrame) -> DataFrame:
        near = pairs.join(ends[0], "a").join(ends[1], "b").withColumn("j", _estimate("ra", "rb", "na", "nb"))
        return confirmed(staged(near.filter(F.col("j") >= PERCENT / 100 - MARGIN).select("a", "b"), "likely"), sets, PERCENT)

    found = bucket_links(members, sets, verify, PERCENT)
    unstage(sets)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row a document."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    slim = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    rows = staged(slim.mapInArrow(_sketch, f"doc_id {kind}, th bigint, n bigint, c bigint, c2 bigint, regs binary"), "sketches")
    named = rows.filter("n > 0 AND doc_id IS NOT NULL")
    first = named.groupBy("c", "c2").agg(F.min("doc_id").alias("doc_id"))
    first = staged(first.withColumn("id", F.monotonically_increasing_id()), "classes")
    classes = named.join(first, ["c", "c2", "doc_id"]).select(F.col("id").alias("c"), "doc_id", "th", "n", "regs").dropDuplicates(["c"])
    classes = staged(classes, "classes")
    between = links(classes, slim)
    reps = classes.select("c", "doc_id")
    pairs = between.join(reps.select(F.col("c").alias("a"), F.col("doc_id").alias("x")), "a").join(reps.select(F.col("c").alias("b"), F.col("doc_id").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    copies = named.select("c", "c2", F.col("doc_id").alias("b")).join(first.select("c", "c2", F.col("doc_id").alias("a")), ["c", "c2"]).filter("a <> b").select("a", "b")
    labels = connected_components(pairs.unionByName(copies))
    out = rows.select("doc_id", F.col("n").alias("n_shingles")).join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs without the documents that are near copies of one with a smaller id; all columns stay. Of rows with one doc_id
    one stays (the first by a hash of its text); rows with a null doc_id all stay."""
    found = staged(near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("k")), "found")
    ids = lambda rows: F.broadcast(rows) if rows.count() <= BROADCAST_ROWS and docs.schema["doc_id"].dataType.typeName() != "string" else rows
    gone = ids(found.filter("NOT kept").select(F.col("doc_id").alias("__ss_id")))
    left = docs.join(gone, docs["doc_id"] == F.col("__ss_id"), "left_anti")
    again = found.filter("kept AND k > 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("__ss_id"))
    if again.isEmpty():
        return left
    repeated = left.join(again, left["doc_id"] == F.col("__ss_id"), "left_semi").withColumn("__ss_th", F.xxhash64("text"))
    one = repeated.groupBy("doc_id").agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), "__ss_th").alias("__ss_row")).select("__ss_row.*")
    return left.join(again, left["doc_id"] == F.col("__ss_id"), "left_anti").unionByName(one)
