"""WARC archives, from monolithic gzip streams to one member for each record.

``write_archives`` writes records as whole-file gzip streams, as many crawlers
leave them. ``normalise`` inflates such a stream once, from its start to its
end, writes every record again as a gzip member of its own, and beside the
archive a sidecar index, a line for each record with its member's place and
length. ``runs`` deals the index out in runs of about ``RUN`` bytes, and
``read_records`` inflates only the members of its run, so that one large archive
is read by many tasks. A payload is never held whole: it is inflated, hashed and rewritten in
pieces.

Files are written under a name of their own and then moved, so a task that runs
twice leaves the same files; only files that a finished task reports are read.

Payloads of at least ``LEAST`` bytes that are equal are stored once, with the
smallest page id; the others become revisit records that name it.

Defined results: a null payload is empty; a null url has no target header; a
null id comes after all others, so it is a response only where all rows of its
payload have none; rows that share the smallest id and the payload are all
responses; an empty table writes nothing; other columns are not read. A stream
that ends early or can't be inflated keeps its whole records, and its report
says so; what its archive has behind them is named by no line of the index.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import shared_path

from .common import drop, written

LEAST = 100
ARCHIVE = 64 << 20  # an archive is closed with the record that reaches so many bytes
RUN = 4 << 20  # bytes of archives that a reading task takes at a time
PIECE = 1 << 18
LEVEL = 4  # of compression: 1.4 % more bytes than level 6 on pages, for two thirds of its time
BROADCAST = 100_000  # up to so many repeated payloads (about 10 MB) go to all tasks; beyond, a join
TASKS = 50_000
DATE = "1970-01-01T00:00:00Z"
VERSION = b"WARC/1.1\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISITED = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"

_FILE_DDL = "archive string, n_records long, n_bytes long"
_NORMAL_DDL = "source string, archive string, sidecar string, n_records long, n_bytes long, error string"


def repeated(pages: DataFrame, id_col: str, payload_col: str, least: int) -> DataFrame:
    """``digest, first_id`` of payloads that several rows have."""
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    sized = pages.select(F.col(id_col).cast("long").alias("id"), payload.alias("payload")).where(F.octet_length("payload") >= least)
    return sized.groupBy(F.sha2("payload", 256).alias("digest")).agg(F.min("id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> tuple[DataFrame, list[str]]:
    """``id, url, payload, digest, refers_to`` of the records to be; ``refers_to`` is null for responses. And the paths written."""
    first, path = written(repeated(pages, id_col, payload_col, least), "warc-repeated")
    small = first.limit(BROADCAST + 1).count() <= BROADCAST
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).join(F.broadcast(first) if small else first, "digest", "left")
    # payloads under the least size have no row there
    revisit = F.col("first_id").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first_id")))
    return rows.select("id", "url", "payload", "digest", F.when(revisit, F.col("first_id")).alias("refers_to")), [path]


def _name(page, digest: str) -> str:
    return f"<{_PAGE}{'' if page is None else page}:{digest}>"


def _page(name: str) -> int | None:
    page = name.strip("<>")[len(_PAGE):].split(":")[0]
    return int(page) if page else None


def record_head(page, url, digest: str, refers_to, size: int, date: str) -> bytes:
    """The headers of a record and of the HTTP message in it; a response's payload follows."""
    http = HTTP % size
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", _name(page, digest)), ("WARC-Date", date)]
    if url is not None:
        # a line's end in a url would end its header
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    fields.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    if refers_to is not None:
        fields += [("WARC-Profile", REVISITED), ("WARC-Refers-To", _name(refers_to, digest))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (size if refers_to is None else 0)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + http


def _info(name: str, date: str) -> bytes:
    body = b"format: WARC File Format 1.1\r\n"
    fields = [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", date), ("WARC-Filename", name),
              ("Content-Type", "application/warc-fields"), ("Content-Length", str(len(body)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + body + b"\r\n\r\n"


class _Moved:
    """A file that appears under its last name once it is whole."""

    def __init__(self, store, path: str):
        self.store, self.path = store, path
        self.own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        self.out, self.size = store.open_output_stream(self.own, compression=None), 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.store.move(self.own, self.path)


def write_archives(rows: DataFrame, path: str, most: int = ARCHIVE, date: str = DATE) -> DataFrame:
    """Writes ``records`` below ``path``, which all executors reach, each archive as one gzip stream; a row for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(path)
        store.create_dir(top, recursive=True)
        part, nth, out, packer, raw, n = TaskContext.get().partitionId(), 0, None, None, 0, 0

        def closed() -> pa.RecordBatch:
            out.write(packer.flush())
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{path}/{out.path.rpartition('/')[2]}"]), pa.array([n]), pa.array([out.size])], names=["archive", "n_records", "n_bytes"])

        for batch in batches:
            columns = [batch.column(c) for c in ("id", "url", "digest", "refers_to", "payload")]
            for row in range(batch.num_rows):
                page, url, digest, refers_to, payload = (c[row] for c in columns)
                payload = payload.as_buffer()
                if out is None:
                    name = f"{part:06d}-{nth:06d}.warc.gz"
                    out, packer, raw, n, nth = _Moved(store, f"{top}/{name}"), zlib.compressobj(LEVEL, zlib.DEFLATED, 31), 0, 0, nth + 1
                    out.write(packer.compress(_info(name, date)))
                out.write(packer.compress(record_head(page.as_py(), url.as_py(), digest.as_py(), refers_to.as_py(), payload.size, date)))
                if not refers_to.is_valid:
                    for at in range(0, payload.size, PIECE):
                        out.write(packer.compress(payload.slice(at, min(PIECE, payload.size - at))))
                    raw += payload.size
                out.write(packer.compress(b"\r\n\r\n"))
                raw, n = raw + 512, n + 1
                if raw >= most:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return rows.withColumn("payload", F.col("payload").cast("binary")).mapInArrow(run, _FILE_DDL)


class Broken(ValueError):
    """A stream that is no whole WARC archive."""


class Inflated:
    """The bytes of a gzip stream of one or more members, in pieces."""

    def __init__(self, read: Callable[[int], bytes]):
        self.read, self.held, self.ended = read, b"", False
        self.rest, self.unzip = b"", zlib.decompressobj(31)

    def more(self) -> bool:
        """Inflates a further piece; False at the end of the file."""
        while True:
            if self.unzip.eof:
                self.rest, self.unzip = self.unzip.unused_data, zlib.decompressobj(31)
                if not self.rest:
                    self.rest = self.read(PIECE)
                if not self.rest:
                    return False
            elif not self.rest:
                self.rest = self.read(PIECE)
                if not self.rest:
                    raise Broken("the stream ends early")
            try:
                piece = self.unzip.decompress(self.rest, PIECE)
            except zlib.error as error:
                raise Broken(f"not a gzip stream: {error}") from error
            self.rest = self.unzip.unconsumed_tail
            if piece:
                self.held += piece
                return True

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """All up to and with ``mark``; None at the end of the file."""
        at = 0
        while (found := self.held.find(mark, at)) < 0:
            at = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > most:
                raise Broken("a header without an end")
            if not self.more():
                if self.held.strip():
                    raise Broken("the archive ends within a header")
                return None
        out, self.held = self.held[:found + len(mark)], self.held[found + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes, in pieces."""
        while n:
            if not self.held and not self.more():
                raise Broken("the archive ends within a record")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, colon, v in (line.partition(":") for line in lines[1:]) if colon}


def warc_records(stream: Inflated) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """Head, headers and block (in pieces) of each record; a block that isn't used up is passed over."""
    while (head := stream.until(b"\r\n\r\n")) is not None:
        head = head.lstrip(b"\r\n")
        if not head.startswith(b"WARC/"):
            raise Broken("no WARC record where one should begin")
        found = headers(head)
        if not found.get("content-length", "").isdigit():
            raise Broken("a record without a length")
        block = stream.take(int(found["content-length"]))
        yield head, found, block
        for _ in block:
            pass
        for piece in stream.take(4):
            if piece.strip(b"\r\n"):
                raise Broken("a record longer than its length")


def _rewrite(store, top: str, name: str, source: str) -> tuple[int, int, str | None]:
    """One archive again, each record a member of its own, and its index; records, bytes and what was wrong."""
    error, n = None, 0
    from_store, at = _opened(source)
    out, index = _Moved(store, f"{top}/{name}"), _Moved(store, f"{top}/{name}.index")
    with from_store.open_input_stream(at, compression=None) as data:
        stream = Inflated(lambda size: data.read(size))
        try:
            for head, found, block in warc_records(stream):
                start, packer = out.size, zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                out.write(packer.compress(head))
                for piece in block:
                    out.write(packer.compress(piece))
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                line = {"offset": start, "length": out.size - start, "id": found.get("warc-record-id"), "type": found.get("warc-type")}
                index.write(json.dumps(line).encode() + b"\n")
                n += 1
        except Broken as broken:
            # a record that isn't whole has no line in the index, so its bytes are never read
            error = str(broken)
    out.close()
    index.close()
    return n, out.size, error


def _opened(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def normalise(archives: DataFrame, path: str) -> DataFrame:
    """Rewrites the archives in column ``archive`` below ``path``; a row for each. A task takes one archive after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _opened(path)
        store.create_dir(top, recursive=True)
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                # archives of one name in several folders stay apart
                name = f"{hashlib.sha256(source.encode()).hexdigest()[:12]}-{source.rpartition('/')[2]}"
                n, size, error = _rewrite(store, top, name, source)
                values = [source, f"{path}/{name}", f"{path}/{name}.index", n, size, error]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["source", "archive", "sidecar", "n_records", "n_bytes", "error"])

    return archives.select("archive").mapInArrow(run, _NORMAL_DDL)


def runs(normal: DataFrame, most: int = RUN) -> DataFrame:
    """``archive, start, end``: the index's records in runs of about ``most`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, index in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist()):
                store, at = _opened(index)
                found, start, end = [], None, 0
                with store.open_input_stream(at, compression=None) as data:
                    for line in _lines(data):
                        one = json.loads(line)
                        start = one["offset"] if start is None else start
                        end = one["offset"] + one["length"]
                        if end - start >= most:
                            found.append((start, end))
                            start = None
                if start is not None:
                    found.append((start, end))
                yield pa.RecordBatch.from_arrays([pa.array([archive] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()),
                                                  pa.array([f[1] for f in found], pa.int64())], names=["archive", "start", "end"])

    return normal.select("archive", "sidecar").mapInArrow(run, "archive string, start long, end long")


def _lines(data) -> Iterator[bytes]:
    held = b""
    while piece := data.read(PIECE):
        *whole, held = (held + piece).split(b"\n")
        yield from whole
    if held:
        yield held


_RECORD = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
                     ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64())])


def read_records(dealt: DataFrame) -> DataFrame:
    """``archive, offset, record_type, page_id, url, refers_to, payload_digest, payload_bytes`` of all responses and
    revisits in the runs ``dealt``. A response's digest and size are those of the bytes read; a revisit's are its header's and null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, start, end in zip(*(batch.column(c).to_pylist() for c in ("archive", "start", "end"))):
                store, at = _opened(archive)
                rows = []
                with store.open_input_file(at) as data:
                    while start < end:
                        row, start = _member(data, archive, start)
                        if row:
                            rows.append(row)
                yield pa.RecordBatch.from_pylist(rows, _RECORD)

    return dealt.mapInArrow(run, "archive string, offset long, record_type string, page_id long, url string, refers_to long, payload_digest string, payload_bytes long")


def _member(data, archive: str, start: int) -> tuple[dict | None, int]:
    """The record of the member at ``start``, and where the next member begins."""
    data.seek(start)
    unzip, used = zlib.decompressobj(31), 0

    def inflate(_: int) -> bytes:
        raise AssertionError

    def pieces() -> Iterator[bytes]:
        nonlocal used
        rest = b""
        while not unzip.eof:
            if not rest:
                rest = data.read(PIECE)
                used += len(rest)
                if not rest:
                    raise Broken(f"{archive}: a member ends early")
            piece = unzip.decompress(rest, PIECE)
            rest = unzip.unconsumed_tail
            if piece:
                yield piece
        used -= len(unzip.unused_data)

    source = pieces()
    stream = Inflated(inflate)
    stream.more = lambda: _held(stream, source)
    row = None
    for _, found, block in warc_records(stream):
        kind = found.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        row = {"archive": archive, "offset": start, "record_type": kind, "page_id": _page(found["warc-record-id"]), "url": found.get("warc-target-uri"),
               "refers_to": _page(found["warc-refers-to"]) if "warc-refers-to" in found else None, "payload_digest": found["warc-payload-digest"].partition(":")[2], "payload_bytes": None}
        if kind == "response":
            sha, size = _payload(block)
            if sha != row["payload_digest"]:
                raise Broken(f"{archive}, byte {start}: the payload doesn't match its digest")
            row["payload_bytes"] = size
    for _ in source:
        pass
    return row, start + used


def _held(stream: Inflated, source: Iterator[bytes]) -> bool:
    piece = next(source, None)
    if piece is None:
        return False
    stream.held += piece
    return True


def _payload(block: Iterator[bytes]) -> tuple[str, int]:
    """Digest and size of what follows the HTTP headers."""
    head, sha, size = b"", hashlib.sha256(), 0
    inside = False
    for piece in block:
        if not inside:
            head += piece
            if (end := head.find(b"\r\n\r\n")) < 0:
                continue
            piece, inside = head[end + 4:], True
        sha.update(piece)
        size += len(piece)
    return sha.hexdigest(), size


def _apart(rows: DataFrame) -> DataFrame:
    """Each row a task of its own, up to ``TASKS``: the rows are few and small, the files that they name are not."""
    return rows.repartition(min(TASKS, max(1, rows.count())))


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = LEAST) -> tuple[DataFrame, list[str]]:
    """Writes, normalises and reads the archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` of
    each page, a revisit's size from the response that it names; and the paths written."""
    spark = pages.sparkSession
    rows, paths = records(pages, id_col, url_col, payload_col, least)
    raw, normal_path = shared_path(spark, "warc-streams"), shared_path(spark, "warc")
    archives, path = written(write_archives(rows, raw), "warc-list")
    paths.append(path)
    normal, path = written(normalise(_apart(archives), normal_path), "warc-index")
    paths += [path, normal_path]
    drop(spark, raw)
    for row in normal.where("error is not null").limit(1).collect():
        raise Broken(f"{row['source']}: {row['error']}")
    dealt, path = written(runs(_apart(normal)), "warc-runs")
    paths.append(path)
    read, path = written(read_records(_apart(dealt)), "warc-read")
    paths.append(path)
    named = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page"), "payload_digest").distinct()
    sizes = read.where("record_type = 'response'").select(F.col("page_id").alias("page"), "payload_digest", F.col("payload_bytes").alias("bytes")).distinct()
    sizes = sizes.join(named, ["page", "payload_digest"], "left_semi")
    revisits = read.where("record_type = 'revisit'").withColumn("page", F.col("refers_to")).join(sizes, ["page", "payload_digest"], "left").withColumn("payload_bytes", F.col("bytes"))
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return read.where("record_type = 'response'").select(columns).unionByName(revisits.select(columns)), paths
