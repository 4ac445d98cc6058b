"""Quality rules: counts of words and repeats, then a linear-chain conditional random field over a text's lines.

Viterbi decoding of the CRF marks each line as content or boilerplate; the share of a text's word characters in content
lines decides. The CRF is trained by gradient ascent on the lines of a bounded sample of labelled documents (SAMPLE,
the first by hash), all lines of each: lines of good documents count as content, of bad ones as boilerplate. Clean lines inside bad
documents are mostly outvoted, since lines like them are common in good ones.

Nulls and edges: a null or empty text has no words and fails the base rules. A line is what stands between "\\n"; lines
without a word carry no weight and follow their neighbours. A null doc_id stays. Repeated rows are judged alike. An empty
table gives an empty result. With no labelled documents of both kinds nothing can be trained and only the base rules
decide. Words are runs of characters other than ASCII white space, so all counts work on UTF-8 bytes. Texts of any length
are taken whole, in the fit and in the verdict; in the fit a sequence of more than SEGMENT lines is several, of one weight
together. Only doc_id, text and quality are read; other columns may have any name and pass through keep_good as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Labelled documents that the CRF is fitted on at most.
SAMPLE = 1500
#: Lines that are one sequence in the fit.
SEGMENT = 64
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT = 10, 20
#: Least share of word characters in content lines.
CONTENT_SHARE = 0.5

_SPACE, _UPPER, _LOWER, _DIGIT, _SYMBOL, _BANG, _END, _PUNCT, _HIGH, _CONTINUED = range(10)


def _classes() -> np.ndarray:
    """The class of each byte, as bits."""
    out = np.zeros(256, np.uint16)
    for i in range(256):
        c = bytes([i])
        bits = {_SPACE: c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"), _UPPER: b"A" <= c <= b"Z", _LOWER: b"a" <= c <= b"z", _DIGIT: b"0" <= c <= b"9", _SYMBOL: c in [SYMBOLS[k : k + 1] for k in range(len(SYMBOLS))], _BANG: c == b"!", _END: c in (b".", b"?", b":", b";"), _PUNCT: i < 128 and not c.isalnum() and i > 32, _HIGH: i >= 192, _CONTINUED: 128 <= i < 192}
        out[i] = sum(1 << k for k, v in bits.items() if v)
    return out


_CLASS = _classes()
N_FEATURES = 14


def line_features(lines: list[bytes], words: list[list[bytes]]) -> np.ndarray:
    """A row of features per line."""
    if not lines:
        return np.zeros((0, N_FEATURES))
    blob = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    kind = _CLASS[blob]

    def per_line(bit: int) -> np.ndarray:
        return np.add.reduceat((kind >> bit) & 1, starts, dtype=np.int64)

    space = per_line(_SPACE) - 1
    chars = np.maximum(sizes - 1 - space - per_line(_CONTINUED), 0)
    some = np.maximum(chars, 1)
    n_words = np.fromiter(map(len, words), np.int64, len(words))
    different = np.fromiter((len(set(w)) for w in words), np.int64, len(words))
    upper, lower, digit = per_line(_UPPER), per_line(_LOWER), per_line(_DIGIT)
    letters = np.maximum(upper + lower, 1)
    ends = np.fromiter((bool(w) and w[-1][-1:] in b".?!\"'" for w in words), bool, len(words))
    mean = chars / np.maximum(n_words, 1)
    symbols = per_line(_SYMBOL)
    return np.column_stack(
        [
            np.ones(len(lines)),
            np.minimum(symbols / np.maximum(n_words, 1), 2),
            symbols == 0,
            np.minimum(per_line(_BANG) / np.maximum(n_words, 1), 1),
            upper / letters,
            upper > 0.6 * letters,
            digit / some,
            np.minimum(per_line(_PUNCT) / some, 1),
            1 - different / np.maximum(n_words, 1),
            different * 2 < n_words,
            np.minimum(n_words, 40) / 40,
            n_words <= 2,
            ends,
            (mean < 2.5) | (mean > 14),
        ]
    ).astype(np.float64)


@dataclass
class Crf:
    """Two labels, 0 boilerplate and 1 content: weights of features by label, of label pairs, and of first labels."""

    features: np.ndarray
    pairs: np.ndarray
    first: np.ndarray

    def content(self, x: np.ndarray) -> np.ndarray:
        """Viterbi: for each line whether the likeliest sequence has it as content."""
        score = (x @ self.features).tolist()
        if not score:
            return np.zeros(0, bool)
        (p00, p01), (p10, p11) = self.pairs.tolist()
        a, b = score[0][0] + float(self.first[0]), score[0][1] + float(self.first[1])
        back = []
        for s0, s1 in score[1:]:
            a0, b0, a1, b1 = a + p00, b + p10, a + p01, b + p11
            back.append((b0 > a0, b1 > a1))
            a, b = max(a0, b0) + s0, max(a1, b1) + s1
        at = int(b >= a)
        out = [at]
        for came in reversed(back):
            at = int(came[at])
            out.append(at)
        return np.array(out[::-1], bool)


def fit_crf(documents: list[tuple[np.ndarray, int]], rounds: int = 150, l2: float = 1e-3) -> Crf | None:
    """Maximum likelihood by gradient steps; documents: (features of lines, label of all lines)."""
    documents = [(x, y) for x, y in documents if len(x)]
    if len({y for _, y in documents}) < 2:
        return None
    sequences = [(x[i : i + SEGMENT], y) for x, y in documents for i in range(0, len(x), SEGMENT)]
    lines = np.array([len(x) for x, _ in documents for _ in range(0, len(x), SEGMENT)], float)
    n, long = len(sequences), max(len(x) for x, _ in sequences)
    x, mask, y = np.zeros((n, long, N_FEATURES)), np.zeros((n, long), bool), np.array([y for _, y in sequences])
    for i, (f, _) in enumerate(sequences):
        x[i, : len(f)], mask[i, : len(f)] = f, True
    good = sum(label == 1 for _, label in documents)
    weight = np.where(y == 1, 0.5 / good, 0.5 / (len(documents) - good))  # both kinds alike, and all documents of a kind
    weight = (weight / lines)[:, None] * mask
    theta = np.zeros(2 * N_FEATURES + 6)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    gold = np.zeros((n, long, 2))
    gold[np.arange(n), :, y] = 1
    for step in range(1, rounds + 1):
        w, pairs, first = theta[: 2 * N_FEATURES].reshape(N_FEATURES, 2), theta[-6:-2].reshape(2, 2), theta[-2:]
        score = x @ w
        forward, backward = np.zeros((n, long, 2)), np.zeros((n, long, 2))
        forward[:, 0] = score[:, 0] + first
        for t in range(1, long):
            forward[:, t] = np.where(mask[:, t, None], np.logaddexp(forward[:, t - 1, :1] + pairs[0], forward[:, t - 1, 1:] + pairs[1]) + score[:, t], forward[:, t - 1])
        for t in range(long - 2, -1, -1):
            nxt = backward[:, t + 1] + score[:, t + 1]
            backward[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:]), 0)
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        node = np.exp(forward + backward - z[:, None, None]) * mask[:, :, None]
        diff = (gold * mask[:, :, None] - node) * weight[:, :, None]
        edge = np.exp(forward[:, :-1, :, None] + pairs + (score[:, 1:] + backward[:, 1:])[:, :, None, :] - z[:, None, None, None]) * mask[:, 1:, None, None]
        g_pairs = np.zeros((2, 2))
        for k in (0, 1):
            g_pairs[k, k] = (weight[:, 1:] * mask[:, 1:] * (y == k)[:, None]).sum()
        g_pairs -= (edge * weight[:, 1:, None, None]).sum((0, 1))
        grad = np.concatenate([np.einsum("ntf,ntk->fk", x, diff).ravel(), g_pairs.ravel(), diff[:, 0].sum(0)]) - l2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Crf(theta[: 2 * N_FEATURES].reshape(N_FEATURES, 2), theta[-6:-2].reshape(2, 2), theta[-2:])


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of five words found at least twice in the text."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.uint64, n)
    if len(number) == n:
        return 0
    windows = np.zeros(n - window + 1, np.uint64)
    for j in range(window):  # 64-bit hashes of the numbers
        windows = (windows ^ (windows >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : n - window + 1 + j] + np.uint64(1)
    _, back, often = np.unique(windows, return_inverse=True, return_counts=True)
    twice = (often > 1)[back]
    if not twice.any():
        return 0
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, np.flatnonzero(twice), 1)
    np.add.at(cover, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


def judge(text: bytes | None, crf: Crf | None, share: float = CONTENT_SHARE) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept)."""
    lines = (text or b"").split(b"\n")
    words = [line.split() for line in lines]
    every = [w for line in words for w in line]
    n = len(every)
    joined = b"".join(every)
    continued = int(((np.frombuffer(joined, np.uint8) & 0xC0) == 0x80).sum())
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line, w in zip(lines, words):
        if w:
            dup += line in seen
            seen.add(line)
    repeats = repeated_words(every)
    failed = n < MIN_WORDS or 100 * repeats > REPEAT_PERCENT * n
    full = [i for i, w in enumerate(words) if w]
    part = 1.0
    if crf is not None and full:
        good = crf.content(line_features([lines[i] for i in full], [words[i] for i in full]))
        size = np.fromiter((sum(map(len, words[i])) for i in full), np.float64, len(full))
        part = float(size[good].sum() / size.sum())
    return n, len(joined) - continued, symbols, dup, repeats, failed, part, not failed and part >= share


NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
SCHEMA = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, content_share double, kept boolean"


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Crf | None:
    """labels: (doc_id, quality). The features of the lines of at most sample documents come to the driver, no texts."""
    chosen = labels.filter("quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", "quality").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("h"), F.col("quality").cast("int").alias("quality"), "text")
    got = texts.mapInArrow(_features, "h bigint, quality int, x array<float>").toArrow().sort_by([("h", "ascending"), ("quality", "ascending")])
    return fit_crf([(np.asarray(x.values, np.float64).reshape(-1, N_FEATURES), y.as_py()) for x, y in zip(got["x"], got["quality"], strict=True)])


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The features of all lines with a word, one row a text."""
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            out = []
            for text in part.column(2).cast(pa.large_binary()).to_pylist():
                lines = [(line, w) for line in (text or b"").split(b"\n") if (w := line.split())]
                out.append(line_features([x[0] for x in lines], [x[1] for x in lines]).astype(np.float32).ravel())
            yield pa.record_batch([part.column(0), part.column(1), pa.array(out, pa.list_(pa.float32()))], names=["h", "quality", "x"])


def quality_rules(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """doc_id and the columns of SCHEMA: one row a document."""
    small_batches(docs.sparkSession)
    crf = train(docs, labels)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                got = [judge(t, crf, share) for t in part.column(1).cast(pa.large_binary()).to_pylist()]
                yield pa.record_batch([part.column(0), *map(pa.array, zip(*got, strict=True))], names=["doc_id", *NAMES])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, {SCHEMA}")


def keep_good(docs: DataFrame, labels: DataFrame, share: float = CONTENT_SHARE) -> DataFrame:
    """docs without the rejected ones; all columns stay."""
    small_batches(docs.sparkSession)
    crf = train(docs, labels)

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                kept = [judge(t, crf, share)[-1] for t in part.column(at).cast(pa.large_binary()).to_pylist()]
                yield part.filter(pa.array(kept, pa.bool_()))

    at = docs.columns.index("text")
    return docs.mapInArrow(good, docs.schema)
