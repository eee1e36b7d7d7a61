"""WARC archives and their capture index, merged from locally sorted runs.

1. A payload's digest tells which captures repeat another: of equal payloads of a least size, the capture with
   the largest id is a response record, the others are revisit records that refer to it.
2. Each task writes archives of its own, one gzip member per record, into a folder that all machines see, and
   returns a sorted run of index entries: URL key, timestamp, place in the archive. A task that is tried again
   writes new files; entries only ever come from the try that ended, so its files are the ones that are read.
3. Runs are dealt out by ranges of (URL key, timestamp, id, place in the archives), as many as the number of entries
   asks for. In each range, a loser tree merges the slices of all runs. What is more than a buffer holds is merged into
   larger runs, kept in files beside the archives, which are read back in pieces; so a task holds a buffer and one piece
   of each run, whatever its range holds. Ranges follow each other, so the result is one globally ordered capture
   history. A URL with a third of all captures falls into as many ranges as it needs, since ids and places part them.
4. Archives are read back along the index, in stretches of one archive each.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import cut, map_batches, shared_dir

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Index entries of a run, bytes of an archive, and bytes that are read at once, at most.
RUN, ARCHIVE, STRETCH = 100_000, 1 << 30, 8 << 20
#: Bytes of an archive that one task reads, about.
CHUNK = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
#: Index entries of a range, about; entries that a merge holds at once; runs that it merges at once; entries of a batch.
RANGE, BUFFER, FAN_IN, PIECE = 250_000, 500_000, 64, 4_096
#: Bytes that the held entries of a merge take at most, about, and those of an entry besides its texts.
HELD, ENTRY = 256 << 20, 600
INDEX = "url_key string, timestamp string, id string, archive string, offset long, length long, record_type string, payload_digest string"
_ORDER = ["url_key", "timestamp", "id", "archive", "offset"]


def store(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a folder given as a URI or a path."""
    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def url_key(url: str | None) -> str:
    """A URL as a sort key: host labels from the last to the first, then path and query, without scheme, `www`,
    default port and fragment, lower-cased. Null is empty; what is no URL is its own key, lower-cased."""
    raw = (url or "").strip().lower()
    try:
        parts = urlsplit(raw)
        host, port = parts.hostname, parts.port
    except ValueError:
        return raw
    if not host:
        return raw
    labels = host.split(".")
    if labels[0].startswith("www") and labels[0][3:].strip("0123456789") == "" and len(labels) > 1:
        labels = labels[1:]
    port_part = f":{port}" if port and (parts.scheme, port) not in (("http", 80), ("https", 443)) else ""
    return ",".join(reversed(labels)) + port_part + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def _urn(key: str | None) -> str:
    return f"<urn:capture:{quote(key or '', safe='')}>"


def _key(urn: str) -> str | None:
    return unquote(urn[len("<urn:capture:") : -1]) or None


def record(key: str | None, url: str | None, date: str, payload: bytes, digest: str, refers_to: str | None, revisit: bool) -> bytes:
    """One record, as it is before compression. The HTTP head of a revisit still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_urn(key)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode().split("\r\n")[1:])
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(data: bytes) -> dict[str, object]:
    """The fields of one record; payload is None for a revisit. Wrong lengths or digests are errors."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')} has another length than it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    revisit = fields["warc-type"] == "revisit"
    count = int(_fields(http)["content-length"])
    if not revisit and (len(payload) != count or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"record {fields['warc-record-id']} has another payload than it says")
    return {
        "id": _key(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "date": fields["warc-date"],
        "record_type": fields["warc-type"], "payload": None if revisit else payload, "payload_bytes": count,
        "payload_digest": digest, "refers_to": _key(fields["warc-refers-to"]) if revisit else None,
    }


def captures(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least: int = LEAST) -> DataFrame:
    """id, url, date, payload, digest, keep: what is to be written; keep is the id of the response, where others repeat it.

    Payloads are moved once, by their digest; a hot payload is split by adaptive skew handling.
    """
    payload = F.coalesce(pages[payload_col].cast("string"), F.lit(""))
    date = F.date_format(pages[date_col].cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'") if date_col else F.lit(None).cast("string")
    base = pages.select(
        pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), F.coalesce(date, F.lit(EPOCH)).alias("date"), payload.alias("payload"),
        F.sha1(payload.cast("binary")).alias("digest"), F.sha2(payload, 256).alias("_sha256"),
    )
    large = base.where(F.octet_length("payload") >= least)
    groups = large.groupBy("_sha256").agg(F.max("id").alias("keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    small = F.octet_length("payload") < least
    key = F.when(small, F.concat(F.lit("-"), F.hex(F.xxhash64("id", "_sha256", "url")))).otherwise(F.col("_sha256"))  # small ones are dealt out and meet nothing
    return base.withColumn("_sha256", key).join(groups, "_sha256", "left").drop("_sha256")


_KINDS = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (c.split() for c in INDEX.split(", "))])


def _batch(entries: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, f.type) for a, f in zip(zip(*entries, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)


def _tuples(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _pieces(entries: Iterator[tuple], size: int) -> Iterator[pa.RecordBatch]:
    while piece := list(islice(entries, size)):
        yield _batch(piece)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes captures() into archives in folder and returns their index, in sorted runs."""
    files, path = store(folder)
    files.create_dir(path, recursive=True)
    text = rows.select(F.col("id").cast("string"), "url", "date", "payload", "digest", F.col("keep").cast("string"), (F.col("keep").isNotNull() & ~F.col("keep").eqNullSafe(F.col("id"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        out, name, offset, entries = None, "", 0, []

        def sorted_run() -> pa.RecordBatch:
            nonlocal entries
            batch, entries = _batch(sorted(entries)), []
            return batch

        try:
            for batch in batches:
                for key, url, date, payload, digest, keep, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if out is None or offset >= ARCHIVE:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out, offset = files.open_output_stream(f"{path}/{name}", compression=None), 0
                    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                    data = pack.compress(record(key, url, date, payload.encode(), digest, keep, revisit)) + pack.flush()
                    out.write(data)
                    stamp = "".join(x for x in date if x.isdigit())
                    entries.append((url_key(url), stamp, key or "", name, offset, len(data), "revisit" if revisit else "response", digest))
                    offset += len(data)
                    if len(entries) >= RUN:
                        yield sorted_run()
        finally:
            if out is not None:
                out.close()
        if entries:
            yield sorted_run()

    return cut(map_batches(text, run, INDEX))


def merged(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """Merges sorted iterators with a tree of losers: each item that is taken out costs log2(k) comparisons."""
    k = len(runs)
    end = object()
    heads: list[object] = [next(r, end) for r in runs]
    beats = lambda a, b: heads[b] is end or (heads[a] is not end and (heads[a], a) < (heads[b], b))
    losers = [-1] * k
    for leaf in range(k):  # each leaf climbs until it meets an empty node, where it waits for its opponent
        winner, node = leaf, (leaf + k) // 2
        while node > 0 and losers[node] >= 0:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[node] = winner
    while k and heads[losers[0]] is not end:
        winner = losers[0]
        yield heads[winner]
        heads[winner] = next(runs[winner], end)
        node = (winner + k) // 2
        while node > 0:
            if beats(losers[node], winner):
                winner, losers[node] = losers[node], winner
            node //= 2
        losers[0] = winner


class Merge:
    """Merges entries that come in sorted stretches, with a bounded memory: what is over `buffer` entries or HELD bytes goes into
    sorted files in a folder, and more than `fan_in` of these are merged into one."""

    def __init__(self, folder: str, buffer: int, fan_in: int, piece: int) -> None:
        self.folder, self.buffer, self.fan_in, self.piece = folder, buffer, fan_in, piece
        self.held: list[list[tuple]] = []
        self.count = self.size = 0
        self.files: list[str] = []

    def add(self, entries: Iterator[tuple]) -> None:
        """Takes entries; a stretch ends where they go down."""
        last = None
        for entry in entries:
            if last is None or entry < last:
                self.held.append([])
            self.held[-1].append(entry)
            last = entry
            self.count += 1
            self.size += ENTRY + sum(len(x) for x in entry if isinstance(x, str))
            if self.count >= self.buffer or self.size >= HELD:
                self._spill()
                last = None

    def _spill(self) -> None:
        self._write([iter(x) for x in self.held])
        self.held, self.count, self.size = [], 0, 0
        if len(self.files) >= self.fan_in:
            before = self.files
            self.files = []
            self._write([self._read(name) for name in before])
            self._delete(before)

    def _write(self, runs: list[Iterator[tuple]]) -> None:
        files, path = store(self.folder)
        files.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.run"
        with files.open_output_stream(name) as out, pa.ipc.new_stream(out, _SCHEMA) as sink:
            for batch in _pieces(merged(runs), self.piece):
                sink.write_batch(batch)
        self.files.append(name)

    def _read(self, name: str) -> Iterator[tuple]:
        files, _ = store(self.folder)
        with files.open_input_stream(name) as source, pa.ipc.open_stream(source) as stream:
            yield from _tuples(stream)

    def _delete(self, names: list[str]) -> None:
        files, _ = store(self.folder)
        for name in names:
            files.delete_file(name)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """All entries in order."""
        runs = [iter(x) for x in self.held] + [self._read(name) for name in self.files]
        yield from _pieces(merged(runs), self.piece)
        self._delete(self.files)


def merge_index(runs: DataFrame, folder: str | None = None, ranges: int | None = None, buffer: int = BUFFER, fan_in: int = FAN_IN) -> DataFrame:
    """One capture history from sorted runs: rows ordered by url_key, timestamp, id, archive, offset, within and across partitions, with
    place: 1, 2, ... in the history of their URL key. A range counts what it merges; a key that ranges cut goes on with the counts before it.

    folder is where tasks keep what their buffer does not hold; ranges is their number, by default that of the entries.
    """
    folder = f"{(folder or new_folder(runs.sparkSession)).rstrip('/')}/runs"
    ranges = ranges or max(1, -(-runs.count() // RANGE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merge, part = Merge(folder, buffer, fan_in, PIECE), TaskContext.get().partitionId()
        merge.add(_tuples(batches))
        last, count = None, 0
        for batch in merge.batches():
            own = []
            for key in batch.column("url_key").to_pylist():
                last, count = key, count + 1 if key == last else 1
                own.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(own), pa.int64()), pa.array(own, pa.int64())], [*_SCHEMA.names, "range", "own"])

    dealt = runs.select(*_SCHEMA.names).repartitionByRange(ranges, *_ORDER)
    numbered = cut(map_batches(dealt, run, f"{INDEX}, range long, own long"))
    counts = numbered.groupBy("url_key", "range").agg(F.max("own").alias("n"))
    shared = counts.groupBy("url_key").agg(F.count("*").alias("ranges")).where("ranges > 1").select("url_key")  # at most one at each border of ranges
    before = Window.partitionBy("url_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.join(F.broadcast(shared), "url_key").select("url_key", "range", F.sum("n").over(before).alias("ahead")).where("ahead is not null")
    out = numbered.join(F.broadcast(ahead), ["url_key", "range"], "left")  # a row a range at most; rows stay in their order
    return out.select(*_SCHEMA.names, (F.col("own") + F.coalesce("ahead", F.lit(0))).alias("place"))


def cdxj(index: DataFrame) -> DataFrame:
    """The index as lines of text, for write.text(): key, timestamp and a JSON object."""
    rest = F.to_json(F.struct("record_type", "payload_digest", "archive", "offset", "length"))
    return index.select(F.concat_ws(" ", "url_key", "timestamp", rest).alias("value"))


RECORD = "id string, url string, date string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to string, place long"


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records that an index names, read from the archives in folder and checked against their digests, with their place in the index."""
    # entries are small and what they stand for is not: tasks are told by the bytes in the archives
    parts = index.agg(F.ceil(F.sum("length") / CHUNK)).first()[0] or 1
    chunk = F.floor(F.col("offset") / CHUNK)
    dealt = index.select("archive", "offset", "length", "place").repartition(2 * parts, "archive", chunk).sortWithinPartitions("archive", "offset")
    fields = [f for f in RECORD.split(", ") if with_payload or not f.startswith("payload binary")]
    names, types = zip(*((n, _KINDS[k]) for n, k in (f.split() for f in fields)), strict=True)

    def stretches(rows: Iterable[tuple[str, int, int, int]]) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
        """Neighbouring records of one archive: its name, the first offset, their lengths and places."""
        name, start, records, size = None, 0, [], 0
        for archive, offset, length, place in rows:
            if archive != name or offset != start + size or size >= STRETCH:
                if records:
                    yield name, start, records
                name, start, records, size = archive, offset, [], 0
            records.append((length, place))
            size += length
        if records:
            yield name, start, records

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = store(folder)
        opened, source = None, None
        for batch in batches:
            for name, start, records in stretches(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                if name != opened:
                    if source is not None:
                        source.close()
                    opened, source = name, files.open_input_file(f"{path}/{name}")
                data, at, rows = source.read_at(sum(length for length, _ in records), start), 0, []
                for length, place in records:
                    rows.append(parse(zlib.decompress(data[at : at + length], 31)) | {"place": place})
                    at += length
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], list(names))
        if source is not None:
            source.close()

    return map_batches(dealt, run, ", ".join(fields))


def new_folder(spark: SparkSession) -> str:
    """A new folder for archives under the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"


def archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date_col: str | None = None, least: int = LEAST
) -> DataFrame:
    """Writes one record per row of pages into archives in folder; returns the globally ordered capture index.

    Of records with equal payloads of at least `least` bytes, the one with the largest id is a response and the
    others revisit it; smaller ones are all responses. A null payload is an empty one; a null URL has no target
    and sorts first; a null date is the epoch. Rows that repeat an id each have a record; those that repeat
    both the id and the payload of a response are responses too. A null id is written as an empty one, read
    back as null, and never referred to unless all equal payloads have it. Other columns of pages are not
    looked at. An empty table writes nothing and gives no rows.
    """
    return merge_index(write_archives(captures(pages, id_col, url_col, payload_col, date_col, least), folder), folder)
