"""Long byte strings that documents share, found by a sparse suffix sort.

A string of SIZE = 50 bytes counts as repeated in a document if it also starts in a document of a smaller id. Sorting the suffixes
at all bytes would move the text many times over, so suffixes are sorted at anchors only: among the 26 parts of 25 bytes of each
string, those with the least hash. Equal strings have equal anchors at equal places, so every repeated string is met at one.

1. Texts go into blocks of some MB, written once, compressed. Equal texts are found by their SHA-256: all but the least id are gone
   whole and take no further part.
2. The anchors' hashes (five bytes each, one per block) are dealt out by hash; back comes one bit each: does another block, or
   another document of this block, have it?
3. Around anchors that others have, 25 bytes to the left and 50 to the right are dealt out by hash, one of several equal ones per
   block. A task sorts the suffixes at the anchors and the reversed prefixes before them (suffixes.py: prefix hashes, binary search for the
   common length, mergesort, check against the bytes). From the common lengths of neighbours follow, for each of 26 offsets, the
   classes of equal strings and each class's least id. Back comes a mask of 26 bits.
4. Each block marks the covered bytes, cuts them out and hashes the rest.

Per block a passage is dealt out once, however many of its documents hold it, so a passage that all documents share meets as many
rows as there are blocks. Answers to blocks are broadcast if they are small (ANSWERS bytes), else joined by a shuffle.

Nulls and edges: a null text counts as empty. A row with a null id is compared with nothing: nothing is removed, and it counts for
no other. Rows of one id are not smaller than each other: what they share stays. Texts under 50 bytes stay whole. Ids are whole
numbers. Other columns are ignored and may have any name. Texts of any length are taken whole; a very long one is a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged, unstage
from .suffixes import sorted_with_common

SIZE, PART = 50, 25
OFFSETS = SIZE - PART + 1
#: Raw bytes of a block, anchors of a bucket, most buckets, and bytes of answers that are still broadcast.
BLOCK, PER_BUCKET, BUCKETS, ANSWERS = 2 << 20, 400_000, 1 << 16, 64 << 20
#: Stands between texts; no UTF-8 byte.
PAD = 0xFF

_random = np.random.default_rng(13)
_VALUE = _random.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _rolling(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all strings of this size, put together from sizes that are powers of two."""
    now, width, power = _VALUE[data], 1, _BASE
    out = out_width = None
    while True:
        if size & 1:
            if out is None:
                out, out_width = now, width
            else:
                n = len(data) - out_width - width + 1
                out = out[:n] * power + now[out_width : out_width + n]
                out_width += width
        size >>= 1
        if not size:
            return out
        n = len(now) - width
        now = now[:n] * power + now[width : width + n]
        with np.errstate(over="ignore"):
            power = power * power
        width *= 2


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) over each `width` entries."""
    have = 1
    while have * 2 <= width:
        x = best(x[: len(x) - have], x[have:])
        have *= 2
    return best(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


class Block:
    """Texts of a block, PAD bytes between them. live: texts that are compared."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, raw: bytes, live: np.ndarray) -> None:
        self.ids, self.sizes, self.live = ids, sizes, live
        self.starts = SIZE + np.concatenate(([0], np.cumsum(sizes[:-1] + SIZE))).astype(np.int64) if len(sizes) else np.zeros(0, np.int64)
        self.data = np.full(int(sizes.sum()) + SIZE * (len(sizes) + 1), PAD, np.uint8)
        self.raw = np.frombuffer(raw, np.uint8)
        self.of_raw = np.arange(len(self.raw)) + np.repeat(self.starts - np.concatenate(([0], np.cumsum(sizes[:-1]))), sizes) if len(self.raw) else np.zeros(0, np.int64)
        self.data[self.of_raw] = self.raw

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, hashes, texts) of the anchors."""
        long = self.live & (self.sizes >= SIZE)
        if not long.any():
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = self.parts = np.maximum(_mix(_rolling(self.data, PART)), np.uint64(1))
        least = _sliding(h, OFFSETS, np.minimum)  # [i]: over the parts of the string at i
        valid = np.zeros(len(least) + 1, np.int8)
        valid[self.starts[long]] += 1
        valid[self.starts[long] + self.sizes[long] - SIZE + 1] -= 1
        least[np.cumsum(valid[:-1]) == 0] = 0
        most = _sliding(np.concatenate((np.zeros(OFFSETS - 1, np.uint64), least, np.zeros(OFFSETS - 1, np.uint64))), OFFSETS, np.maximum)
        at = np.flatnonzero(h == most[: len(h)])
        return at, _mix(h[at] ^ np.uint64(0x5851F42D4C957F2D)), np.searchsorted(self.starts, at, side="right") - 1

    def hashes_around(self, at: np.ndarray) -> np.ndarray:
        """Hashes of the bytes of around(at), from those of their three parts, which anchors() has worked out."""
        return (self.parts[at - PART] * _BASE + self.parts[at]) * _BASE + self.parts[at + PART] if len(at) else np.zeros(0, np.uint64)

    def around(self, at: np.ndarray) -> np.ndarray:
        """25 bytes before each place and 50 from it on."""
        return self.data[at[:, None] + np.arange(-PART, SIZE)]


def _first_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first of each key, in the keys' order; the number of each entry's key)."""
    order = np.argsort(keys, kind="stable")
    new = np.concatenate((np.ones(min(len(keys), 1), bool), keys[order][1:] != keys[order][:-1]))
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _five(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _wide(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(b, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


class Anchored:
    """The anchors of a block by bucket: per distinct hash one entry, in the order in which it is dealt out."""

    def __init__(self, block: Block, bits: int) -> None:
        self.at, hashes, self.text = block.anchors()
        self.first, self.number = _first_of(hashes)
        one = hashes[self.first]
        self.bucket = (one >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(one), np.int64)
        low, high = np.full(len(one), np.iinfo(np.int64).max), np.full(len(one), np.iinfo(np.int64).min)
        ids = block.ids[self.text]
        np.minimum.at(low, self.number, ids)
        np.maximum.at(high, self.number, ids)
        short = (one >> np.uint64(max(0, 64 - bits - 39))) & np.uint64(2**39 - 1)
        self.sent = short << np.uint64(1) | (low != high).astype(np.uint64)

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        edges = np.flatnonzero(np.diff(self.bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield int(self.bucket[a]), slice(int(a), int(b))

    def shared(self, answers: dict[int, bytes]) -> np.ndarray:
        """Anchors that another document has."""
        yes = np.zeros(len(self.first), bool)
        for bucket, part in self.by_bucket():
            n = part.stop - part.start
            yes[part] = np.unpackbits(np.frombuffer(answers[bucket], np.uint8), count=n).astype(bool) if bucket in answers else False
        return np.flatnonzero(yes[self.number])


class Fragments:
    """The surroundings of the shared anchors of a block, one of several equal ones, by bucket."""

    def __init__(self, block: Block, anchored: Anchored, answers: dict[int, bytes]) -> None:
        which = anchored.shared(answers)
        self.at = anchored.at[which]
        bucket = anchored.bucket[anchored.number[which]]
        hashes = block.hashes_around(self.at)
        first, self.number = _first_of(hashes)
        if any((block.around(self.at[i : i + 65536]) != block.around(self.at[first[self.number[i : i + 65536]]])).any() for i in range(0, len(self.at), 65536)):
            rows = block.around(self.at)  # two surroundings with one hash
            _, first, self.number = np.unique(rows, axis=0, return_index=True, return_inverse=True)
            self.number = self.number.ravel()
        ids = block.ids[anchored.text[which]]
        self.low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(self.low, self.number, ids)
        self.least = ids == self.low[self.number]  # of the texts with these bytes, that with the least id
        order = np.lexsort((hashes[first], bucket[first]))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.number, self.low, self.bucket = rank[self.number], self.low[order], bucket[first][order]
        self.places = self.at[first][order]

    by_bucket = Anchored.by_bucket

    def masks(self, answers: dict[int, bytes]) -> np.ndarray:
        """Per anchor the offsets whose string is repeated: for the least id what the other blocks say, for others all. Offsets that
        would reach over a text's end add no byte to those of the offsets that don't, of which an anchor has one at least."""
        mask = np.zeros(len(self.places), np.int64)
        for bucket, part in self.by_bucket():
            mask[part] = np.frombuffer(answers[bucket], "<i4")
        return np.where(self.least, mask[self.number], 2**OFFSETS - 1)


def repeated_offsets(rows: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """A mask per row of 75 bytes: bit o says that the string starting o bytes before the anchor is also around an anchor of a
    smaller id. parts: numbers of the rows' 25 bytes from the anchor on (equal parts, equal numbers)."""
    n = len(rows)
    right_order, right = sorted_with_common(np.ascontiguousarray(rows[:, PART:]), parts)
    left_order, left = sorted_with_common(np.ascontiguousarray(rows[:, PART - 1 :: -1]), parts)
    inside = rows != PAD
    has_left = np.where(inside[:, :PART].all(1), PART, inside[:, PART - 1 :: -1].argmin(1))
    has_right = np.where(inside[:, PART:].all(1), SIZE, inside[:, PART:].argmin(1))
    out = np.zeros(n, np.int64)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(OFFSETS):
        a[right_order] = np.cumsum(right < SIZE - o)
        b[left_order] = np.cumsum(left < o)
        first, number = _first_of(a * np.int64(n + 1) + b)
        low = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(low, number, ids)
        out |= ((low[number] < ids) & (has_left >= o) & (has_right >= SIZE - o)).astype(np.int64) << o
    return out


def covered(n: int, at: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """Of n bytes those that a repeated string covers; masks: its offsets before each anchor."""
    starts = np.zeros(n, np.int32)
    for o in range(OFFSETS):
        starts[at[(masks >> o) & 1 == 1] - o] = 1
    sums = np.cumsum(starts, dtype=np.int32)
    return sums > np.concatenate((np.zeros(SIZE, np.int32), sums[:-SIZE]))


# ---------------------------------------------------------------- Spark


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard
    from pyspark import TaskContext

    pack = zstandard.ZstdCompressor(level=3).compress
    part, k = TaskContext.get().partitionId(), 0
    ids, texts, held = [], [], 0

    def row() -> pa.RecordBatch:
        raw = b"".join(texts)
        sizes = pa.array([len(t) for t in texts], pa.int64())
        digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
        one = pa.array([0, len(texts)], pa.int32())
        lists = [pa.ListArray.from_arrays(one, x) for x in (pa.array(ids, pa.int64()), sizes, digests)]
        return pa.record_batch([pa.array([part << 32 | k], pa.int64()), *lists, pa.array([pack(raw)], pa.binary())], names=["block", "ids", "sizes", "digests", "data"])

    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            for d, t in zip(batch.column(0).slice(i, 128).to_pylist(), batch.column(1).slice(i, 128).cast(pa.large_binary()).to_pylist(), strict=True):
                ids.append(d)
                texts.append(t or b"")
                held += len(texts[-1])
                if held >= BLOCK or len(texts) >= 100_000:
                    yield row()
                    k, ids, texts, held = k + 1, [], [], 0
    if ids:
        yield row()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Block]]:
    """Rows (block, ids, sizes, data, copies, ...) as (row, Block)."""
    import zstandard

    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            ids = pa.array(row["ids"].values) if not isinstance(row["ids"].values, pa.Array) else row["ids"].values
            none = np.asarray(ids.is_null())
            known = ids.fill_null(0).to_numpy(zero_copy_only=False)
            gone = np.zeros(len(known), bool)
            gone[row["copies"].as_py() or []] = True
            raw = zstandard.ZstdDecompressor().decompress(row["data"].as_py()) if len(row["data"].as_py()) else b""
            yield row | {"gone": gone}, Block(known, row["sizes"].values.to_numpy(zero_copy_only=False), raw, ~(gone | none))


def _answers(row: dict, name: str) -> dict[int, bytes]:
    return {x["bucket"]: x["bits"] for x in row[name].as_py() or []}


def _deal_anchors(bits: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _read(batches):
            a = Anchored(block, bits)
            parts = list(a.by_bucket())
            yield pa.record_batch([pa.array([row["block"].as_py()] * len(parts), pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array([_five(a.sent[s]) for _, s in parts], pa.binary())], names=["block", "bucket", "sent"])

    return deal


def _met(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """A bit for each hash of each block: does it come from another block, or from two documents of one?"""
    each = [_wide(x) for x in rows["sent"]]
    both = np.concatenate(each)
    first, number = _first_of(both >> np.uint64(1))
    often = np.bincount(number) > 1
    often |= np.bincount(number, weights=(both & np.uint64(1)).astype(float)) > 0
    ends = np.cumsum([len(x) for x in each])
    yes = [np.packbits(x) for x in np.split(often[number], ends[:-1])]
    keep = [i for i, x in enumerate(yes) if x.any()]
    return pd.DataFrame({"block": rows["block"].to_numpy()[keep], "bucket": int(key[0]), "bits": [yes[i].tobytes() for i in keep]})


def _deal_fragments(bits: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=3).compress
        for row, block in _read(batches):
            f = Fragments(block, Anchored(block, bits), _answers(row, "met"))
            parts = list(f.by_bucket())
            data = [pack(block.around(f.places[s]).tobytes()) for _, s in parts]
            ids = [f.low[s].astype("<i8").tobytes() for _, s in parts]
            yield pa.record_batch([pa.array([row["block"].as_py()] * len(parts), pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array(data, pa.binary()), pa.array(ids, pa.binary())], names=["block", "bucket", "data", "low"])

    return deal


def _judged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    each = [np.frombuffer(unpack(x), np.uint8).reshape(-1, PART + SIZE) for x in rows["data"]]
    ids = np.concatenate([np.frombuffer(x, "<i8") for x in rows["low"]])
    both = np.concatenate(each)
    h = np.zeros(len(both), np.uint64)
    for j in range(PART, PART + PART):
        h = h * _BASE + _VALUE[both[:, j]]
    _, parts = _first_of(h)  # a collision here only puts rows together that the sort tells apart
    alone = np.bincount(parts)[parts] == 1
    masks = np.zeros(len(both), np.int64)
    some = np.flatnonzero(~alone)
    if len(some):
        masks[some] = repeated_offsets(both[some], ids[some], parts[some])
    ends = np.cumsum([len(x) for x in each])
    return pd.DataFrame({"block": rows["block"].to_numpy(), "bucket": int(key[0]), "bits": [x.astype("<i4").tobytes() for x in np.split(masks, ends[:-1])]})


def _cut(bits: int, with_text: bool):
    """(row, kept text or none) of each document of a block."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _read(batches):
            f = Fragments(block, Anchored(block, bits), _answers(row, "met"))
            masks = f.masks(_answers(row, "masks"))
            gone = covered(len(block.data), f.at, masks)[block.of_raw]
            ends = np.cumsum(block.sizes)
            copies = row["gone"] & (block.sizes >= SIZE)
            gone |= np.repeat(copies, block.sizes)
            at = np.concatenate(([0], ends[:-1]))
            sums = np.concatenate(([0], np.cumsum(gone)))
            removed = sums[ends] - sums[at]
            begins = gone.copy()
            begins[1:] &= ~gone[:-1]
            heads = at[(block.sizes > 0)]
            begins[heads] = gone[heads]
            runs = np.concatenate(([0], np.cumsum(begins)))
            spans = runs[ends] - runs[at]
            left = np.concatenate(([0], np.cumsum(block.sizes - removed)))
            kept = block.raw[~gone].tobytes()
            out = [kept[a:b] for a, b in zip(left[:-1], left[1:], strict=True)]
            digests = row["digests"].as_py()
            sha = [(hashlib.sha256(x).hexdigest() if r else d.hex()) for x, r, d in zip(out, removed.tolist(), digests, strict=True)]
            cols = [row["ids"].values, pa.array(block.sizes), pa.array(removed), pa.array(spans), pa.array(sha)]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            yield pa.record_batch([*cols, pa.array(out, pa.binary())] if with_text else cols, names=[*names, "kept"] if with_text else names)

    return cut


def _joined(blocks: DataFrame, answers: DataFrame, name: str, column) -> DataFrame:
    """blocks with their answers as a list: broadcast where the answers are small, else a shuffle."""
    grouped = staged(answers.groupBy("block").agg(F.collect_list(column).alias(name)), name)
    size = F.sum(F.length(F.to_json(F.struct(name)))) if name == "copies" else F.sum(F.aggregate(name, F.lit(0).cast("bigint"), lambda s, x: s + F.length(x["bits"]) + 16))
    small = (grouped.agg(size).first()[0] or 0) <= ANSWERS
    return blocks.join(F.broadcast(grouped) if small else grouped, "block", "left")


def remove_repeats(docs: DataFrame, with_text: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes that stay): one row a document."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").alias("text"))
    schema = "block bigint, ids array<bigint>, sizes array<bigint>, digests array<binary>, data binary"
    blocks = staged(rows.mapInArrow(_to_blocks, schema), "text-blocks")
    texts = blocks.select("block", F.posexplode(F.arrays_zip("ids", "sizes", "digests")).alias("place", "x")).select("block", "place", F.col("x.ids").alias("id"), F.col("x.sizes").alias("size"), F.col("x.digests").alias("digest"))
    total = texts.agg(F.sum("size")).first()[0] or 0
    low = texts.filter("id IS NOT NULL").groupBy("digest").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    copies = texts.join(low, "digest").filter("id > low").select("block", "place")
    blocks = _joined(blocks, copies, "copies", F.col("place"))
    bits = min(BUCKETS.bit_length() - 1, max(0, int(total * 2 / (OFFSETS + 1)) // PER_BUCKET).bit_length())
    sent = blocks.select("block", "ids", "sizes", "data", "copies").mapInArrow(_deal_anchors(bits), "block bigint, bucket int, sent binary")
    met = sent.groupBy("bucket").applyInPandas(_met, "block bigint, bucket int, bits binary")
    blocks = _joined(blocks, met, "met", F.struct("bucket", "bits"))
    dealt = blocks.select("block", "ids", "sizes", "data", "copies", "met").mapInArrow(_deal_fragments(bits), "block bigint, bucket int, data binary, low binary")
    masks = dealt.groupBy("bucket").applyInPandas(_judged, "block bigint, bucket int, bits binary")
    blocks = _joined(blocks, masks, "masks", F.struct("bucket", "bits"))
    out = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    return blocks.mapInArrow(_cut(bits, with_text), out + ", kept binary" if with_text else out)
