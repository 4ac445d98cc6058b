"""WARC archives: a writer with revisit records, and a reader that salvages damaged archives.

Each task writes archive files of SEGMENT bytes or so, one gzip member per record, to the shared folder, under names of
its own; a manifest lists the files of the tasks that succeeded, so a lost executor or a second attempt leaves at most
unlisted files. Of pages with equal payloads the one with the smallest page_id is a response, the others are revisits.

The reader checks each member: the gzip check sum, the version line, the length, and the digest of block and payload.
After a failed check it looks for the next place where a member or a version line, whichever is nearer, starts and holds
a record that passes, and logs the bytes between as a gap. A member may hold many records: behind a damaged one the
inflated stream is searched for the next version line, and the gap is logged with its offsets inside the member. What a
member that cannot be inflated holds behind the byte that fails is lost. Records of a damaged member that come back are known
by their digests, which do not cover the header's fields. Files are read in pieces, a record is held whole.

Nulls and edges: a null html is an empty payload; a null url an empty target. Rows with one page_id and equal payloads
are all responses (or all revisits of a smaller id). Null ids: "null" in the archive, null again when read; in a group
whose ids are all null every row is a response. An empty table gives no archives and no records. Only page_id, url and
html are read.
"""

from __future__ import annotations

import base64
import collections
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import maybe_broadcast, new_folder, small_batches, staged

SEGMENT, PIECE, HEADER = 64 << 20, 4 << 20, 1 << 20
VERSION = b"WARC/1."
BROADCAST_ROWS = 500_000
DATE = "2024-01-01T00:00:00Z"
_URN = "urn:stepspan:page:"


def sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One WARC/1.1 record, not compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "null" if page_id is None else page_id
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{_URN}{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((url or "").split()))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{_URN}{refers_to}>")]
    fields += [("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("WARC-Payload-Digest", f"sha1:{sha1(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, refers_to of the pages that repeat the payload of one with a smaller id."""
    html = F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8"))
    slim = staged(pages.select("page_id", F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).filter(F.col("n") >= min_bytes), "digests")
    first = slim.groupBy("digest", "n").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("k")).filter("k > 1").select("digest", "refers_to")
    first = staged(first, "first")
    return slim.join(first, "digest").filter("page_id <> refers_to").select("page_id", "digest", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes one record a row under folder; the manifest: path, records, bytes."""
    small_batches(pages.sparkSession)
    again = staged(revisits(pages, min_bytes), "revisits").select(F.col("page_id").alias("again_id"), F.col("digest").alias("again_digest"), "refers_to")
    digest = F.sha1(F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8")))
    rows = pages.select("page_id", "url", "html")
    rows = rows.join(maybe_broadcast(again, again.count(), BROADCAST_ROWS), (F.col("page_id") == F.col("again_id")) & (digest == F.col("again_digest")), "left").select("page_id", "url", "html", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        out, path, n, size, listed = None, "", 0, 0, []
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                part = batch.slice(i, 128)
                for page, url, html, refers in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2).cast(pa.large_binary()).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if out is None:
                        path, n, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = fs.open_output_stream(path, compression=None)
                    data = member(record(page, url, html or b"", refers))
                    out.write(data)
                    n, size = n + 1, size + len(data)
                    if size > SEGMENT:
                        out.close()
                        listed.append((path, n, size))
                        out = None
        if out is not None:
            out.close()
            listed.append((path, n, size))
        yield pa.record_batch([pa.array([x[0].removeprefix(root) for x in listed], pa.string()), pa.array([x[1] for x in listed], pa.int64()), pa.array([x[2] for x in listed], pa.int64())], names=["path", "records", "bytes"])

    listed = staged(rows.mapInArrow(write, "path string, records bigint, bytes bigint"), "manifest")
    return listed.withColumn("path", F.concat(F.lit(folder), "path"))


class Pieces:
    """Random access to a file, read in pieces."""

    def __init__(self, file) -> None:
        self.file, self.size, self.at, self.held = file, file.size(), 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, PIECE))
        return self.held[at - self.at : at - self.at + n]

    def find(self, what: bytes, at: int) -> int:
        """The first place of what from at on; the size if there is none."""
        while at < self.size:
            data = self.read(at, min(PIECE, self.size - at))
            if (k := data.find(what)) >= 0:
                return at + k
            at += max(1, len(data) - len(what) + 1)
        return self.size


class Broken(ValueError):
    """A check failed."""


def parse(data: bytes | bytearray) -> tuple[dict[str, str], bytes, int]:
    """Header fields (lower-case), block and length of the record at the start of data."""
    head = data.find(b"\r\n\r\n", 0, HEADER)
    if not data.startswith(VERSION) or head < 0:
        raise Broken("version or header")
    fields = {}
    for line in data[:head].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line")
        fields[key.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    if not fields.get("content-length", "").isdigit():
        raise Broken("content length")
    end = head + 4 + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Broken("length")
    block = bytes(data[head + 4 : end])
    if (said := fields.get("warc-block-digest", "")).startswith("sha1:") and said[5:] != sha1(block):
        raise Broken("block digest")
    if fields.get("warc-type") == "response" and (said := fields.get("warc-payload-digest", "")).startswith("sha1:") and said[5:] != sha1(payload_of(block)):
        raise Broken("payload digest")
    return fields, block, end + 4


def payload_of(block: bytes) -> bytes:
    return block.partition(b"\r\n\r\n")[2]


class Member:
    """The inflated stream of the gzip member at a place, pulled by length. data begins at base, counted inside the member."""

    def __init__(self, file: Pieces, at: int) -> None:
        self.file, self.start, self.pos, self.base, self.data = file, at, at, 0, bytearray()
        self.z, self.tail, self.error, self.sound = zlib.decompressobj(31), b"", None, None
        self.marks = collections.deque([(0, at)])  # so much is inflated once the file is read up to there

    def pull(self, n: int) -> bool:
        """Whether data has n bytes, after reading what is needed. What a damaged member holds before the byte that fails is
        read too, then error says why it ends."""
        while len(self.data) < n and not self.z.eof and not self.error:
            given = self.tail or self.file.read(self.pos, min(16384, self.file.size - self.pos))
            try:
                out = self.z.decompress(given, n - len(self.data))
            except zlib.error:
                out, self.error = self._up_to_the_fault(), "gzip"
            else:
                self.tail = b"" if self.z.eof else self.z.unconsumed_tail
                self.pos += len(given) - len(self.z.unused_data if self.z.eof else self.tail)
                if not given and not out and not self.z.eof:
                    self.error = "cut off"
            self.data += out
            self.marks.append((self.base + len(self.data), self.pos))
        return len(self.data) >= n

    def _up_to_the_fault(self) -> bytes:
        """Inflates anew up to what is known, then byte by byte; nothing is held of what is known."""
        z, pos, known, tail = zlib.decompressobj(31), self.start, self.base + len(self.data), b""
        while known:
            given = tail or self.file.read(pos, min(16384, self.file.size - pos))
            known -= len(z.decompress(given, known))
            tail = z.unconsumed_tail
            pos += len(given) - len(tail)
        more = bytearray()
        try:
            while byte := self.file.read(pos, min(1, self.file.size - pos)):
                more += z.decompress(byte)
                pos += 1
        except zlib.error:
            pass
        self.pos = pos
        return bytes(more)

    def vouches(self, fields: dict[str, str]) -> bool:
        """Whether a record that passed is to be believed: by its digest, else by the check sum of the whole member, for which
        the member is read through once."""
        if fields.get("warc-block-digest", "").startswith("sha1:"):
            return True
        if self.sound is None:
            z, pos, tail = zlib.decompressobj(31), self.start, b""
            try:
                while not z.eof and (given := tail or self.file.read(pos, min(16384, self.file.size - pos))):
                    z.decompress(given, PIECE)
                    tail = z.unconsumed_tail
                    pos += len(given) - len(tail)
            except zlib.error:
                pass
            self.sound = z.eof
        return self.sound

    def drop(self, n: int) -> None:
        self.base += n
        del self.data[:n]
        while len(self.marks) > 1 and self.marks[1][0] <= self.base:
            self.marks.popleft()

    def place(self, inner: int) -> int:
        """Up to where the file must be read for so many inflated bytes."""
        return next((pos for n, pos in self.marks if n >= inner), self.pos)

    def record(self) -> tuple[dict[str, str], bytes, int]:
        """The record at the start of data; it is held whole, as long as its header says."""
        n, head = 512, -1
        while head < 0:
            more = self.pull(n)
            if not self.data.startswith(VERSION):
                raise Broken("version line")
            head = self.data.find(b"\r\n\r\n", 0, HEADER)
            if head < 0 and (not more or n >= HEADER):
                raise Broken(self.error or "header")
            n *= 2
        if not self.pull(head + 8 + _length_in(self.data[:head])):
            raise Broken(self.error or "length")
        return parse(self.data)

    def to_next_version(self) -> None:
        """Drops data up to the next version line behind its first byte, all of it if there is none."""
        self.drop(1)
        while (k := self.data.find(VERSION)) < 0:
            self.drop(max(0, len(self.data) - len(VERSION) + 1))
            if not self.pull(len(self.data) + 65536) and VERSION not in self.data:
                k = len(self.data)
                break
        self.drop(k)


def _gzip_records(file: Pieces, at: int) -> Iterator[tuple]:
    """(kind, end in the file, fields or reason, block, start and end inside the member) for the gzip member at `at`: its
    records and the gaps between them, last a gap without ends if the member is damaged. A record is given once the next begins
    or damage follows, if it is vouched for; the last one once the member's check sum is right or other damage explains it."""
    m, held, gap, hurt = Member(file, at), None, None, False
    while m.pull(1):
        start = m.base
        try:
            fields, block, size = m.record()
        except Broken as e:
            if held and m.vouches(held[2]):
                yield held
            elif held:
                start = held[4]
            gap, held, hurt = gap or (start, str(e)), None, True
            m.to_next_version()
            continue
        if held and not m.vouches(held[2]):
            gap, held, hurt = (held[4], "no digest in a damaged member"), None, True
        if gap and m.vouches(fields):
            yield "gap", m.place(start), gap[1], b"", gap[0], start
            gap = None
        elif gap:
            m.drop(size)
            continue
        if held:
            yield held
        held = ("record", m.place(start + size), fields, block, start, start + size)
        m.drop(size)
    if m.error and held and hurt and m.vouches(held[2]):
        yield held
        held = None
    if m.error:
        start, reason = gap or ((held[4] if held else m.base), m.error)
        yield "gap", None, reason, b"", start, None
    elif gap:
        yield "gap", m.pos, gap[1], b"", gap[0], m.base
    elif held:
        yield held[0], m.pos, *held[2:]
    else:
        yield "gap", m.pos, "no record", b"", 0, 0


def _length_in(head: bytes) -> int:
    for line in head.split(b"\r\n"):
        if line.lower().startswith(b"content-length:") and line[15:].strip().isdigit():
            return int(line[15:])
    return 0


def _plain_records(file: Pieces, at: int) -> Iterator[tuple]:
    """As _gzip_records, for the one record that begins at `at`."""
    n, head = 16384, -1
    while head < 0:
        data = file.read(at, min(n, file.size - at))
        head = data.find(b"\r\n\r\n", 0, HEADER)
        if head < 0 and (n >= HEADER or at + n >= file.size):
            yield "gap", None, "header", b"", None, None
            return
        n *= 2
    need = head + 8 + _length_in(data[:head])
    try:
        if at + need > file.size or need > PIECE and file.read(at + need - 4, 4) != b"\r\n\r\n":  # a wrong length is not read for
            raise Broken("length")
        fields, block, size = parse(file.read(at, need))
    except Broken as e:
        yield "gap", None, str(e), b"", None, None
    else:
        yield "record", at + size, fields, block, None, None


def salvage(file: Pieces) -> Iterator[tuple]:
    """("record", start, end, fields, block, inner_start, inner_end) for what passes all checks, ("gap", start, end, reason, b"",
    inner_start, inner_end) for the rest. start and end share the bytes of the file out, in its order; the inner ones, null outside
    of gzip members, count inflated bytes of a member and are exact. The inner end of a gap is null where it leaves its member."""
    magics = {b"\x1f\x8b\x08": _gzip_records, VERSION: _plain_records}
    at, lost, places = 0, None, dict.fromkeys(magics, -1)
    while at < file.size:
        head, start = file.read(at, min(7, file.size - at)), at
        read = next((r for m, r in magics.items() if head.startswith(m)), None)
        for kind, end, what, block, *inner in read(file, at) if read else [("gap", None, "version line", b"", None, None)]:
            if end is not None:
                if lost:
                    yield "gap", lost[0], at, lost[1], b"", lost[2], None
                    lost = None
                end = max(at, end)
                yield kind, at, end, what, block, *inner
                at = end
                continue
            lost = lost or (at, what, inner[0])
            after = max(at, start + 1)
            for m in magics:
                if places[m] < after:
                    places[m] = file.find(m, after)
            at = min(places.values())
    if lost:
        yield "gap", lost[0], file.size, lost[1], b"", lost[2], None


SCHEMA = "kind string, path string, start bigint, end bigint, inner_start bigint, inner_end bigint, reason string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def read_archives(spark: SparkSession, manifest: DataFrame, payload: bool = True) -> DataFrame:
    """manifest: (path). The records and gaps of all files, as SCHEMA; a file is read by one task."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 4, *[pa.string()] * 6, pa.int64(), pa.binary()]

        def given(rows: list[tuple]) -> pa.RecordBatch:
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, inside = pa.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                size = 0
                with fs.open_input_file(inside) as file:
                    for kind, start, end, fields, block, *inner in salvage(Pieces(file)):
                        if kind == "gap":
                            rows.append((kind, path, start, end, *inner, fields, *[None] * 7))
                        else:
                            revisit = fields.get("warc-type") == "revisit"
                            data = None if revisit else payload_of(block)
                            rows.append((kind, path, start, end, *inner, None, fields.get("warc-type"), fields.get("warc-record-id"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha1:"), None if revisit else len(data), data if payload else None))
                            size += len(block) if payload else 200
                        if len(rows) >= 1000 or size > 8 << 20:
                            yield given(rows)
                            rows, size = [], 0
                if rows:
                    yield given(rows)

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInArrow(read, SCHEMA)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to: read back from archives written of pages."""
    spark = pages.sparkSession
    kind = pages.schema["page_id"].dataType
    manifest = write_archives(pages, new_folder(spark, "warc"), min_bytes)
    got = read_archives(spark, manifest, payload=False)

    def page(c: str):
        return F.expr(f"try_cast(regexp_extract({c}, ':page:(.*)>$', 1) AS {kind.simpleString()})")

    got = staged(got.select("kind", "path", page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")), "records")
    if gaps := got.filter("kind = 'gap'").count():
        raise RuntimeError(f"{gaps} damaged places in archives just written, one in {got.filter('kind = \'gap\'').first().path}")
    got = got.filter("kind = 'record'").drop("kind", "path")
    sizes = got.filter("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("full"))
    sizes = staged(sizes, "sizes")
    out = got.join(sizes, ["refers_to", "payload_digest"], "left")
    return out.select("page_id", F.coalesce("payload_bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
