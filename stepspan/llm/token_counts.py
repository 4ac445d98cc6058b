"""Token counts: pieces are counted once per distinct pre-token and joined to each document's pre-token frequencies.

A pre-token is a chunk between ASCII white space; the tokenizer drops white space and never makes a piece across it, so a
text's count is the sum of its chunks' counts; some probes check this of the given tokenizer. Chunks of ASCII are lowered
beforehand (the tokenizer does it too), but not those with "<|", where special strings are matched before lower-casing, nor
any with other characters, which the tokenizer composes before it lowers them. No ids are kept.

Frequencies follow Zipf's law. The most frequent pre-tokens, HEAD and HEAD_BYTES in all at most, go to all tasks, so most of
a text is summed where it is read; only the rare rest is dealt out by pre-token and joined. Where the head ends comes from a
histogram of the frequencies. A pre-token over LONG bytes is never in the head; the join splits it if it is common.

Nulls: a null text counts as empty: 0 bytes, 0 tokens. A null doc_id stays. Repeated rows stay. Only doc_id and text are
read, other columns may have any name. Texts of any length are taken whole; a very long chunk is one pre-token.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, staged

#: Pre-tokens sent to every task, their bytes in all, and the longest of them in bytes.
HEAD, HEAD_BYTES, LONG = 100_000, 8 << 20, 4096
LIMIT = 2048


def chunks(text: bytes) -> list[bytes]:
    if text.isascii() and b"<|" not in text:
        return text.lower().split()
    return [w.lower() if w.isascii() and b"<|" not in w else w for w in text.split()]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, n): counts of a task's chunks, given out whenever many are gathered."""

    def given(seen: Counter) -> Iterator[pa.RecordBatch]:
        keys = list(seen)
        for i in range(0, len(keys), 20_000):
            part = keys[i : i + 20_000]
            yield pa.record_batch([pa.array(part, pa.binary()), pa.array([seen[k] for k in part], pa.int64())], names=["chunk", "n"])

    seen: Counter = Counter()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            for text in batch.column(0).slice(i, 128).cast(pa.large_binary()).to_pylist():
                if text:
                    seen.update(chunks(text))
            if len(seen) > 200_000:
                yield from given(seen)
                seen = Counter()
    yield from given(seen)


#: Texts whose counts must be the sums of their chunks' counts.
_PROBES = ("of the end", "a\tb\n c", "  x  ", "it's 1,000 %s", "Ünï \u0301x J\u030c", "new york new\r\nyork")


def _check(path: str) -> None:
    """Raises if the tokenizer makes pieces across white space."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    for text in _PROBES:
        parts = [len(t.encode(w.decode(), add_special_tokens=False)) for w in chunks(text.encode())]
        if len(t.encode(text, add_special_tokens=False)) != sum(parts):
            raise ValueError(f"{path}: pieces cross white space, so pre-tokens can't be counted apart")


def _head(vocabulary: DataFrame, head: int, head_bytes: int) -> dict[bytes, int]:
    """The pre-tokens of the highest frequency classes that fit the bounds; a histogram tells how many classes those are."""
    short = vocabulary.filter(F.length("chunk") <= LONG).withColumn("cls", F.floor(F.log2("n") * 16).cast("int"))
    rows = bytes_ = 0
    first = None
    for cls, k, size in sorted(map(tuple, short.groupBy("cls").agg(F.count("*"), F.sum(F.length("chunk"))).collect()), reverse=True):
        rows, bytes_ = rows + k, bytes_ + size
        if rows > head or bytes_ > head_bytes:
            break
        first = cls
    if first is None:
        return {}
    top = short.filter(F.col("cls") >= first).select("chunk", "pieces").toArrow()
    return dict(zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True))


def _pieces(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the work; threads of the library only cost memory
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                words = [w.decode("utf-8", "replace") for w in part.column(0).to_pylist()]
                got = [len(e) for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(got, pa.int32())], names=["chunk", "n", "pieces"])

    return count


def _counted(head):
    """(doc_id, n_bytes, head_tokens, rest): what the head gives, and the other chunks with their frequencies."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                sizes, sums, ends, words, often = [], [], [0], [], []
                for text in part.column(1).cast(pa.large_binary()).to_pylist():
                    total = 0
                    for w, f in Counter(chunks(text or b"")).items():
                        if (p := known.get(w)) is None:
                            words.append(w)
                            often.append(f)
                        else:
                            total += p * f
                    sizes.append(len(text or b""))
                    sums.append(total)
                    ends.append(len(words))
                rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(often, pa.int32())], ["chunk", "f"]))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), rest], names=["doc_id", "n_bytes", "head_tokens", "rest"])

    return count


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit; one row a document."""
    spark = docs.sparkSession
    small_batches(spark)
    _check(tokenizer_path)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    vocabulary = docs.select("text").mapInArrow(_vocabulary, "chunk binary, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    vocabulary = staged(vocabulary.mapInArrow(_pieces(tokenizer_path), "chunk binary, n bigint, pieces int"), "vocabulary")
    known = spark.sparkContext.broadcast(_head(vocabulary, head, HEAD_BYTES))
    counted = docs.select("doc_id", "text").mapInArrow(_counted(known), f"doc_id {id_type}, n_bytes bigint, head_tokens bigint, rest array<struct<chunk:binary,f:int>>")
    counted = staged(counted.withColumn("row", F.monotonically_increasing_id()), "token-rows")
    rest = counted.select("row", F.explode("rest").alias("x")).select("row", "x.chunk", "x.f")
    sums = rest.join(vocabulary.select("chunk", "pieces"), "chunk").groupBy("row").agg(F.sum(F.col("f") * F.col("pieces")).alias("rest_tokens"))
    n = F.col("head_tokens") + F.coalesce("rest_tokens", F.lit(0))
    return counted.select("row", "doc_id", "n_bytes", "head_tokens").join(sums, "row", "left").select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))
