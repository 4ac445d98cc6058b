"""Benchmark decontamination: near copies of benchmark items inside documents, by edit distance.

Texts are lower-cased and their white space made single. A window starts at each word, behind punctuation, and at each place of
a run of SEED or more characters without a space, and is as long as the shortest item of its length class. The CGK walk embeds a window: it reads a character per step, emits it, and moves on or stays by a random
bit that depends on step and character; edit distance becomes Hamming distance. TABLES samples of SAMPLED positions of
the embedding (over WALKS walks) are the keys of locality-sensitive hash tables of the items. What shares a key with an
item is a candidate; the exact edit distance of the item to its best place near the window decides (MAX_DISTANCE of the
item's length).

The tables alone miss copies near the limit, so pieces complete them, without a miss. An item of LONG or more characters is
cut into d // 2 + 1 pieces, of 9 characters or more: in any copy with d edits or fewer some piece has no more than one. All
places of the text that hold the first PIECE characters of a piece, up to one edit, are found by hashes of what is left without one character.
A place stays if the two, then the six pieces around it have 3 and 11 edits at most, as they have for one piece of every
copy (of two parts with fewer than twice as many edits as pieces one has so too), and if the least edits of all parts of six
pieces, wherever they may lie, come to d at most. Only windows near such places are walked; what the
walk does not find is a candidate all the same.

Items of SEED to LONG - 1 characters leave the walk too little to tell: they are found without it. Of d + 1
pieces of an item one is whole in any copy with d edits, so each place of the text that holds a piece is looked at, first
by bit vectors over folded characters for many places at once (never above the true distance), then as all candidates.

The items are sent to all tasks in blocks of BLOCK at most, with one pass over the documents per block. Nulls and edges:
null or wordless texts and items match nothing; items under SEED characters are searched as they are, as whole words, or
anywhere in text of scripts without spaces. A null doc_id or item_id stays as it is. Repeated rows are reported each. Only doc_id, text, item_id and text are read.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

MAX_DISTANCE = 0.2
WALKS, TABLES, SAMPLED = 6, 192, 4
SEED, PIECE = 12, 9
LONG = 64
BLOCK = 20_000
#: Windows walked together.
TOGETHER = 8192
#: Places of text, and pairs of a place and an item, looked at together; places hashed together.
PLACES, HASHED = 1 << 18, 1 << 17

_EVEN = np.uint64(0x9E3779B97F4A7C15)
_WEIGHTS = np.random.default_rng(4).integers(0, 2**32, PIECE, dtype=np.uint32) | np.uint32(1)
_SPREAD = np.uint32(0x9E3779B1)


#: Punctuation and symbols, by code; characters of scripts without spaces.
_MARKS = np.array([unicodedata.category(chr(i))[0] in "PS" for i in range(0x3100)] + [False])
_UNSPACED = "[\u0e00-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff]"


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def word_starts(codes: np.ndarray) -> np.ndarray:
    if not len(codes):
        return np.zeros(0, np.int64)
    return np.concatenate([[0], np.flatnonzero(codes == 32) + 1])


def seed_starts(codes: np.ndarray) -> np.ndarray:
    """Places of windows and seeds: words, what follows punctuation, and each place with SEED characters and no space."""
    first = word_starts(codes)
    if not len(codes):
        return first
    size = np.diff(np.append(first, len(codes) + 1)) - 1
    long = size > SEED
    more = size[long] - SEED
    inside = np.repeat(first[long] + 1 - np.cumsum(more) + more, more) + np.arange(more.sum())
    behind = np.flatnonzero(_MARKS[np.minimum(codes[:-1], len(_MARKS) - 1)] & (codes[1:] != 32)) + 1
    return np.unique(np.concatenate([first, inside, behind]))


def seed_hashes(codes: np.ndarray, at: np.ndarray, size: int = SEED) -> np.ndarray:
    """Of the size characters from each place on; codes reaches size beyond the last place."""
    h = np.zeros(len(at), np.uint64)
    for j in range(size):
        h = (h ^ codes[at + j]) * _EVEN
        h ^= h >> np.uint64(29)
    return h


def folded(codes: np.ndarray) -> np.ndarray:
    """Characters as bytes; different ones may meet."""
    return (codes ^ (codes >> 8)).astype(np.uint8)


def walk(codes: np.ndarray, start: np.ndarray, end: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """CGK: (steps, windows) characters, as bytes; 0 after a window's end. moves: (steps, 256) of 0 or 1."""
    at, out = start.copy(), np.empty((len(moves), len(start)), np.uint8)
    small = folded(codes)
    last = len(small) - 1
    for j, move in enumerate(moves):
        c = small[np.minimum(at, last)]
        c[at >= end] = 0
        out[j] = c
        at += move[c]
    return out


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to any part of text, and where the leftmost such part ends (Myers' bit vectors)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    pv, mv, score, best, at = full, 0, m, m, 0
    for i, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        if mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, i + 1
    return best, at


class Bits:
    """Patterns of under LONG characters as bit vectors over so many classes of folded characters (a power of two, 256 at most)."""

    def __init__(self, patterns: list[np.ndarray], most: list[int], classes: int = 256) -> None:
        self.size, self.most = np.array([len(p) for p in patterns], np.int64), np.array(most, np.int64)
        self.classes = np.uint8(classes - 1)
        self.masks = np.zeros((len(patterns), classes), np.uint64)
        for row, p in enumerate(patterns):
            np.bitwise_or.at(self.masks[row], folded(p) & self.classes, np.uint64(1) << np.arange(len(p), dtype=np.uint64))

    def within(self, small: np.ndarray, start: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Whether the pattern of row may be within its distance of a part of the text around start."""
        most = self.most[row]
        return self.least(small, start, row, most) <= most

    def least(self, small: np.ndarray, start: np.ndarray, row: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """The least distance of the pattern of row to a part of the text that begins within reach of start (Myers' bit vectors, one
        word a pattern); characters that fold alike count as equal."""
        size, one = self.size[row], np.uint64(1)
        full, top = (one << size.astype(np.uint64)) - one, one << (size - 1).astype(np.uint64)
        pv, mv, score, best = full.copy(), np.zeros(len(row), np.uint64), size.copy(), size.copy()
        masks, base, first = self.masks.ravel(), row * self.masks.shape[1], start - reach
        for i in range(int((size + 2 * reach).max(initial=0))):
            eq = masks.take(base + (small.take(first + i, mode="clip") & self.classes))
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            score += ((ph & top) > 0).astype(np.int64) - ((mh & top) > 0)
            ph, mh = ph << one & full, mh << one & full
            pv, mv = mh | ~(xv | ph) & full, ph & xv
            np.minimum(best, score, out=best)
        return best


def _table(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.uint32]:
    """Hashes in order, their rows, and which of their first bits occur."""
    h = h * _SPREAD
    order = np.argsort(h, kind="stable")
    bits = min(max(16, len(h).bit_length() + 6), 26)
    shift = np.uint32(32 - bits)
    bitmap = np.zeros(1 << bits, bool)
    bitmap[h >> shift] = True
    return h[order], row[order], bitmap, shift


class LongItems:
    """Items of LONG or more characters, by pieces of which one has one edit at most. items: (number, normal text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        number, offset, first, nodes, item = [], [], [], ([], []), []
        self.most, self.nodes = np.array([int(MAX_DISTANCE * len(t)) for _, t in items], np.int64), np.zeros(len(items) + 1, np.int64)
        for i, (k, t) in enumerate(items):
            codes = codes_of(t)
            n = int(MAX_DISTANCE * len(t)) // 2 + 1
            cuts = np.linspace(0, len(t), n + 1).astype(np.int64)
            for j, at in enumerate(cuts[:-1]):
                number.append(k), offset.append(at), first.append(codes[at : at + PIECE]), item.append(i)
            for level, wide in zip(nodes, (2, 6), strict=True):
                for j in range(0, n, wide):
                    end = min(j + wide, n)
                    level += [(codes[cuts[j] : cuts[end]], 2 * (end - j) - 1, int(cuts[j]), end - j)]
            self.nodes[i + 1] = len(nodes[1])
        self.item, self.at = np.array(item, np.int64), np.array([x[2] for x in nodes[1]], np.int64)
        self.number, self.offset = np.array(number, np.int64), np.array(offset, np.int64)
        self.levels = []
        for level in nodes:
            of_piece = np.repeat(np.arange(len(level)), [x[3] for x in level])
            ahead = self.offset - np.array([x[2] for x in level], np.int64)[of_piece] if level else self.offset
            self.levels.append((of_piece, ahead, Bits([x[0] for x in level], [x[1] for x in level], 32)))
        x, rows = np.array(first, np.uint32).reshape(-1, PIECE), np.arange(len(number))
        h = (x * _WEIGHTS).sum(1, dtype=np.uint32)
        # what is left of a piece without one of its characters (without the last: as with another last one, below)
        less = [(np.delete(x, i, 1) * _WEIGHTS[:-1]).sum(1, dtype=np.uint32) for i in range(PIECE - 1)]
        self.less = _table(np.concatenate(less), np.tile(rows, PIECE - 1))
        self.other = [None] + [_table(h - x[:, i] * _WEIGHTS[i], rows) for i in range(1, PIECE)]
        self.whole = _table(h, rows)

    def _hashed(self, codes: np.ndarray, begin: int, end: int) -> Iterator[tuple[tuple, np.ndarray]]:
        """Tables, and the hashes to look up in them, of the places begin to end."""
        x = [codes[begin + j : end + j] for j in range(PIECE + 1)]
        weighed = [x[j] * _WEIGHTS[j] for j in range(PIECE)]
        h = np.zeros(end - begin, np.uint32)
        for part in weighed[:-1]:
            h += part
        yield self.less, h  # a character is missing
        h = h + weighed[-1]
        for i in range(1, PIECE):  # none, or one is another (the first: as if it were missing, one place on)
            yield self.other[i], h - weighed[i]
        h = np.zeros(end - begin, np.uint32)
        for j in range(PIECE):
            h += x[j + 1] * _WEIGHTS[j]
        for i in range(1, PIECE):  # one is too many
            h = h + (x[i - 1] - x[i]) * _WEIGHTS[i - 1]
            yield self.whole, h

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """As ShortItems.candidates."""
        if not len(self.number):
            return
        small, last, kept, spans, held = folded(codes), len(codes) - SEED, [], [], 0
        for begin in range(0, last, HASHED):
            for (known, rows, bitmap, shift), h in self._hashed(codes, begin, min(begin + HASHED, last)):
                h = h * _SPREAD
                at = np.flatnonzero(bitmap.take(h >> shift))
                h = h[at]
                left = np.searchsorted(known, h)
                met = known.take(left, mode="clip") == h
                at, left = at[met] + begin, left[met]
                done = np.concatenate([[0], np.cumsum(np.searchsorted(known, h[met], "right") - left)])
                for i in range(0, int(done[-1]), PLACES):
                    pair = np.arange(i, min(i + PLACES, int(done[-1])))
                    where = np.searchsorted(done, pair, "right") - 1
                    spans.append(at[where] * len(self.number) + rows[left[where] + pair - done[where]])
                    held += len(pair)
                    if held >= PLACES:
                        kept += self._kept(small, spans)
                        spans, held = [], 0
            if held >= HASHED:
                kept += self._kept(small, spans)
                spans, held = [], 0
        if spans:
            kept += self._kept(small, spans)
        for place, row in kept:
            near = self._sums(small, place - self.offset[row], self.item[row])
            place, row = place[near], row[near]
            yield place, place - self.offset[row], self.number[row]

    def _sums(self, small: np.ndarray, start: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether the least distances of the parts of an item near where it would start come to its number of edits at most."""
        n = self.nodes[item + 1] - self.nodes[item]
        pair = np.repeat(np.arange(len(item)), n)
        node = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n) + self.nodes[item][pair]
        least = self.levels[1][2].least(small, start[pair] + self.at[node], node, self.most[item][pair])
        return np.bincount(pair, least, len(item)) <= self.most[item]

    def _kept(self, small: np.ndarray, spans: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of places and pieces (one number for both) those whose neighbours fit."""
        every = np.unique(np.concatenate(spans))
        for i in range(0, len(every), PLACES):
            place, row = np.divmod(every[i : i + PLACES], len(self.number))
            for of_piece, ahead, bits in self.levels if len(row) else ():
                near = bits.within(small, place - ahead[row], of_piece[row])
                place, row = place[near], row[near]
            if len(row):
                yield place, row


class ShortItems:
    """Items under LONG characters, by their pieces. items: (number, normal text)."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.numbers = np.array([k for k, _ in items], np.int64)
        self.most = np.array([int(MAX_DISTANCE * len(t)) for _, t in items], np.int64)
        self.bits = Bits([codes_of(t) for _, t in items], self.most.tolist())
        pieces: dict[int, list[tuple[int, int, int]]] = {}
        for row, (_, t) in enumerate(items):
            codes = codes_of(t)
            cuts = np.linspace(0, len(t), int(self.most[row]) + 2).astype(np.int64)
            for at, end in zip(cuts, cuts[1:]):
                size = int(min(5, end - at))
                pieces.setdefault(size, []).append((int(seed_hashes(codes, np.array([at]), size)[0]), row, int(at)))
        self.tables = []
        for size, found in pieces.items():
            h, row, at = (np.array(c, d) for c, d in zip(zip(*sorted(found), strict=True), (np.uint64, np.int64, np.int64), strict=True))
            bitmap = np.zeros(1 << 20, bool)
            bitmap[(h >> np.uint64(44)).astype(np.int64)] = True
            self.tables.append((size, h, row, at, bitmap))

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Places of pieces in codes, where their item would start (it may do so up to its number of edits before or behind), and
        its number: all that can be within its distance."""
        small = folded(codes)
        for size, known, rows, offsets, bitmap in self.tables:
            for begin in range(0, len(codes) - SEED, PLACES):
                at = np.arange(begin, min(begin + PLACES, len(codes) - SEED))
                h = seed_hashes(codes, at, size)
                hit = bitmap[(h >> np.uint64(44)).astype(np.int64)]
                at, h = at[hit], h[hit]
                left = np.searchsorted(known, h)
                n = np.searchsorted(known, h, "right") - left
                done = np.concatenate([[0], np.cumsum(n)])
                for i in range(0, int(done[-1]), PLACES):
                    pair = np.arange(i, min(i + PLACES, int(done[-1])))
                    where = np.searchsorted(done, pair, "right") - 1
                    piece = left[where] + pair - done[where]
                    row, place = rows[piece], at[where]
                    start = place - offsets[piece]
                    near = self.bits.within(small, start, row)
                    yield place[near], start[near], self.numbers[row[near]]


class Index:
    """The hash tables of a block of items, and the pieces of short ones."""

    def __init__(self, items: list[tuple], seed: int = 4) -> None:
        self.items = [(i, t) for i, t in ((i, normal(t)) for i, t in items) if t]
        random = np.random.default_rng(seed)
        edge = rf"(?:(?<![^ ])|(?<={_UNSPACED})|(?={_UNSPACED}))", rf"(?:(?![^ ])|(?<={_UNSPACED})|(?={_UNSPACED}))"
        self.short = [(k, t, re.compile(edge[0] + re.escape(t) + edge[1])) for k, (_, t) in enumerate(self.items) if len(t) < SEED]
        by_class: dict[int, list[int]] = {}
        self.pieces = ShortItems([(k, t) for k, (_, t) in enumerate(self.items) if SEED <= len(t) < LONG])
        for k, (_, t) in enumerate(self.items):
            if len(t) >= LONG:
                by_class.setdefault(len(t).bit_length(), []).append(k)
        self.long = LongItems([(k, t) for k, (_, t) in enumerate(self.items) if len(t) >= LONG])
        self.classes = []
        for bits, members in sorted(by_class.items()):
            sizes = [len(self.items[k][1]) for k in members]
            low = min(sizes)
            blob = [np.concatenate([codes_of(self.items[k][1]), np.zeros(SEED, np.uint32)]) for k in members]
            at = np.concatenate([[0], np.cumsum([len(c) for c in blob])[:-1]])
            joined = np.concatenate(blob)
            tables = []
            for _ in range(WALKS):
                moves = random.integers(0, 2, (2 * low, 256), dtype=np.uint8)
                got = walk(joined, at, at + low, moves)
                places = [np.sort(random.choice(2 * low, min(SAMPLED, 2 * low), replace=False)) for _ in range(TABLES // WALKS)]
                keys = []
                for p in places:
                    h = self.key(got, p)
                    order = np.argsort(h, kind="stable")
                    keys.append((p, h[order], np.array(members)[order]))
                tables.append((moves, keys))
            self.classes.append((low, tables))

    @staticmethod
    def key(embedded: np.ndarray, places: np.ndarray) -> np.ndarray:
        h = np.zeros(embedded.shape[1], np.uint64)
        for p in places:
            h = (h << np.uint64(8)) | embedded[p]
        return h

    def candidates(self, coded: dict[int, np.ndarray], near: dict[int, set[tuple[int, int]]]) -> Iterator[tuple[int, int, int]]:
        """coded: texts; near: (place, item) of each -> (text, place, item): the windows, the last that start at or before these
        places, that share a key with the item."""
        wanted: dict[int, set[int]] = {}
        begin, of_window = 0, {}
        for d, codes in coded.items():
            starts = seed_starts(codes)
            for s, k in near[d]:
                w = int(starts[np.searchsorted(starts, s, "right") - 1])
                wanted.setdefault(begin + w, set()).add(k)
                of_window[begin + w] = d, w, begin + len(codes)
            begin += len(codes)
        joined = np.concatenate(list(coded.values()) or [np.zeros(0, np.uint32)])
        walked = np.array(sorted(wanted), np.int64)
        stop = np.array([of_window[w][2] for w in walked.tolist()], np.int64)
        for low, tables in self.classes:
            for i in range(0, len(walked), TOGETHER):
                part = walked[i : i + TOGETHER]
                for moves, keys in tables:
                    got = walk(joined, part, np.minimum(part + low, stop[i : i + TOGETHER]), moves)
                    for places, known, member in keys:
                        k = self.key(got, places)
                        left, right = np.searchsorted(known, k), np.searchsorted(known, k, "right")
                        for w in np.flatnonzero(right > left):
                            for item in wanted[int(part[w])].intersection(member[left[w] : right[w]].tolist()):
                                yield (*of_window[int(part[w])][:2], item)

    def matches(self, texts: list[str]) -> list[tuple]:
        """(text, item id, start word, end word, distance, similarity) of each item found in each text, best place only."""
        plain = [normal(t) for t in texts]
        coded = [codes_of(t) for t in plain]
        sizes = np.array([len(c) + SEED for c in coded], np.int64)
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        codes = np.concatenate([x for c in coded for x in (c, np.zeros(SEED, np.uint32))] or [np.zeros(0, np.uint32)])
        places: dict[tuple[int, int], list[int]] = {}
        wanted: dict[int, set[tuple[int, int]]] = {}  # text -> (place, item)
        for items in (self.long, self.pieces):
            for piece, start, number in items.candidates(codes):
                text = np.searchsorted(begin, piece, "right") - 1
                for d, k, s in zip(text.tolist(), number.tolist(), np.maximum(start - begin[text], 0).tolist(), strict=True):
                    places.setdefault((d, k), []).append(s)
                    if items is self.long:
                        wanted.setdefault(d, set()).add((s, k))
        for d, s, k in self.candidates({d: coded[d] for d in wanted}, wanted):
            places[d, k].append(s)
        out = []
        for (d, k), where in sorted(places.items()):
            name, item = self.items[k]
            most, best, checked = int(MAX_DISTANCE * len(item)), None, -1
            for s in sorted(where):
                if s <= checked:
                    continue
                lo, hi = max(0, s - most), s + 2 * len(item)
                checked = s + len(item) // 2  # a match that starts up to here ends before hi
                distance, end = edit_distance_within(item, plain[d][lo:hi])
                if distance <= most and (best is None or distance < best[0]):
                    back, size = edit_distance_within(item[::-1], plain[d][lo : lo + end][::-1])
                    best = (distance, lo + end - size, lo + end)
            if best:
                first = plain[d].count(" ", 0, best[1]) + (plain[d][best[1] : best[1] + 1] == " ")
                out.append((d, name, first, plain[d].count(" ", 0, best[2] - 1) + 1, best[0], 1 - best[0] / len(item)))
        for k, short, whole in self.short:
            for d, t in enumerate(plain):
                if short in t and (m := whole.search(t)):
                    first = t.count(" ", 0, m.start())
                    out.append((d, self.items[k][0], first, first + short.count(" ") + 1, 0, 1.0))
        return out


def _blocks(benchmark: DataFrame, block: int) -> Iterator[list[tuple]]:
    n = benchmark.count()
    parts = -(-n // block)
    for i in range(parts):
        rows = benchmark if parts == 1 else benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i)
        yield [tuple(r) for r in rows.select("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, item_id, start_word, end_word, distance, similarity: the best place of each item in each document."""
    small_batches(docs.sparkSession)
    ids = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, start_word bigint, end_word bigint, distance bigint, similarity double"
    item_type = benchmark.select("item_id").schema[0].dataType
    out = None
    for items in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            index, kind = Index(shared.value), to_arrow_type(item_type)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    got = index.matches(part.column(1).to_pylist())
                    rows = list(zip(*got, strict=True)) or [[]] * 6
                    yield pa.record_batch([part.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], kind), *(pa.array(r, pa.int64()) for r in rows[2:5]), pa.array(rows[5], pa.float64())], names=["doc_id", "item_id", "start_word", "end_word", "distance", "similarity"])

        got = docs.select("doc_id", "text").mapInArrow(search, schema)
        out = got if out is None else out.unionByName(got)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, block: int = BLOCK) -> DataFrame:
    """docs without those that hold a benchmark item; all columns stay."""
    small_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for items in _blocks(benchmark, block):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Index(shared.value)
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    leaky = {m[0] for m in index.matches(part.column(at).to_pylist())}
                    yield part.filter(pa.array([k not in leaky for k in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
