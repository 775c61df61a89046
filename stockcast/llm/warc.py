"""WARC archives with an index: write records and their offsets, read selected byte ranges back.

Writing: payload digests decide which record of equal payloads is the response (the largest id) and which
revisit it. Pages are dealt to archives by a hash of id and payload; the task that holds an archive's pages
writes one gzip member per record to the archive's file and yields the index row of each (archive, offset,
length, id, url, digest, type). The index is kept in the shared folder. An archive's records have one total order
(id, digest, url), so a lost or repeated task writes the very same bytes; it writes under its attempt's name
and renames the file into place only where there is none yet.

Reading: index rows of the wanted records are sorted by (archive, offset) and neighbouring ranges less than
``gap`` bytes apart are read in one piece, at most ``window`` bytes at a time; no archive is read or held whole. The
tasks of a read are a stated number, one per archive up to READ_TASKS, as an index has few bytes for much work.

Archives are files in the folder of spark.checkpoint.dir, reached by its URI from each task, and the
folder must be one that pyarrow.fs opens (local, hdfs, s3, gs). ``round_trip`` deletes them once they are read.

Edge cases: a null payload is the empty payload; a null or odd url is written as an empty target URI; rows that
repeat both id and payload are responses each; a null id is written as an empty id and can't be referred to: with others it
revisits the largest, and where all ids of a payload are null all are responses; payloads of any length are records, one held
at a time; an empty table writes no file and gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut, ensure_checkpoint_dir, quoted

#: Payload bytes of an archive, about, and archives of one write at most; bytes between ranges that one read may span; bytes of a read; tasks of a read at most.
ARCHIVE_BYTES, MOST_ARCHIVES, GAP, WINDOW, READ_TASKS = 8_000_000, 20_000, 65_536, 4_194_304, 20_000
#: Fixed value: all records carry one date, so that reruns write the same bytes.
DATE = "2024-01-01T00:00:00Z"
_INDEX = "archive long, offset long, length long, page_id long, record_type string, payload_digest string, url string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; a revisit has no payload."""
    target = "".join((url or "").split())
    body = b"" if refers_to is not None else payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head = "\r\n".join([*lines, f"Content-Length: {len(body)}", "", ""])
    return head.encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    return headers, rest[: int(headers["Content-Length"])]


def _gzip(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, wbits=31)
    return squeeze.compress(data) + squeeze.flush()


def _file(folder: str, archive: int) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder)
    return fs, f"{path}/archive-{archive:08d}.warc.gz"


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all pages and returns the index, one row per record, kept in the checkpoint folder.

    Equal payloads of min_bytes bytes and more become one response and revisits of it; smaller ones are responses.
    """
    payload = F.coalesce(F.col(quoted(payload_col)), F.lit("")).cast("binary")
    keyed = pages.select(F.col(quoted(id_col)).cast("long").alias("page_id"), F.col(quoted(url_col)).alias("url"), payload.alias("payload")).withColumn("sha", F.sha1("payload"))
    sums = cut(keyed.select("page_id", "sha", F.length("payload").alias("size")))
    total = sums.agg(F.sum("size")).first()[0] or 0
    archives = max(1, min(MOST_ARCHIVES, -(-total // archive_bytes)))
    archive = F.pmod(F.xxhash64("page_id", "sha"), F.lit(archives)).alias("archive")
    first = sums.filter(F.col("size") >= min_bytes).groupBy(F.col("sha").alias("_sha")).agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    revisits = sums.join(first, F.col("sha") == F.col("_sha")).filter("not (first <=> page_id)").select(archive, "page_id", "sha", "first").distinct()
    # what a page refers to travels beside it, so payloads are shuffled once, to their archives
    stream = keyed.select(archive, "page_id", "url", "payload", "sha").unionByName(revisits, allowMissingColumns=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, attempt, archive, offset, place = None, TaskContext.get().taskAttemptId(), None, 0, None
        holder, refers_to = None, None  # the current id and payload, and what they refer to

        def close() -> None:
            if out is not None:
                out.close()
                fs, path, written = place
                if fs.get_file_info(path).type == pafs.FileType.NotFound:
                    fs.move(written, path)
                else:  # another attempt has written the same bytes
                    fs.delete_file(written)

        for batch in batches:
            rows: list[tuple] = []
            for values in zip(*batch.columns, strict=True):
                number, page_id, url, data, sha, first_id = (x.as_py() for x in values)
                if (number, page_id, sha) != holder:
                    holder, refers_to = (number, page_id, sha), first_id
                if data is None:
                    continue
                if number != archive:
                    close()
                    archive, offset = number, 0
                    fs, path = _file(folder, archive)
                    fs.create_dir(path.rpartition("/")[0], recursive=True)
                    place = (fs, path, f"{path}.{attempt}")
                    out = fs.open_output_stream(place[2])
                name = digest(data)
                member = _gzip(record(page_id, url, data, name, refers_to))
                out.write(member)
                rows.append((archive, offset, len(member), page_id, "response" if refers_to is None else "revisit", name, url))
                offset += len(member)
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _INDEX.split(", ")])
        close()

    dealt = stream.repartition("archive").sortWithinPartitions("archive", "page_id", "sha", F.col("payload").isNotNull(), "url")
    return cut(dealt.mapInArrow(run, _INDEX))


def ranges(rows: list[tuple[int, int]], gap: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, end row, offset, length) of each read that covers sorted (offset, length) rows."""
    i = 0
    while i < len(rows):
        start, end, j = rows[i][0], sum(rows[i]), i + 1
        while j < len(rows) and rows[j][0] <= end + gap and sum(rows[j]) - start <= window:
            end = max(end, sum(rows[j]))
            j += 1
        yield i, j, start, end - start
        i = j


def read_records(index: DataFrame, folder: str, gap: int = GAP, window: int = WINDOW) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload) of the records that the index rows name.

    payload is null for revisits, payload_digest is as the header has it.
    """
    names = ["page_id", "record_type", "refers_to", "payload_digest", "payload"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def number(urn: str | None) -> int | None:
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, archive = None, None
        for batch in batches:
            archives = batch.column(0).to_pylist()
            spans = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            edges = [0, *(i for i in range(1, len(spans)) if archives[i] != archives[i - 1]), len(spans)]
            for a, b in zip(edges, edges[1:], strict=False):
                if a == b:
                    continue
                if archives[a] != archive:
                    archive = archives[a]
                    fs, path = _file(folder, archive)
                    source = fs.open_input_file(path)
                for i, j, offset, length in ranges(spans[a:b], gap, window):
                    block, rows = source.read_at(length, offset), []
                    for at, n in spans[a + i : a + j]:
                        headers, body = parse(zlib.decompress(block[at - offset : at - offset + n], wbits=31))
                        kind = headers["WARC-Type"]
                        rows.append((number(headers["WARC-Record-ID"]), kind, number(headers.get("WARC-Refers-To")), headers["WARC-Payload-Digest"].removeprefix("sha1:"), body if kind == "response" else None))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    archives = index.agg(F.max("archive")).first()[0]
    tasks = 1 if archives is None else min(READ_TASKS, archives + 1)
    sorted_rows = index.select("archive", "offset", "length").repartition(tasks, "archive").sortWithinPartitions("archive", "offset")
    return sorted_rows.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_digest string, payload binary")


def archive_folder(df: DataFrame) -> str:
    """A new folder for archives below the checkpoint folder, as a URI."""
    root = ensure_checkpoint_dir(df.sparkSession)
    if root.startswith(("file:", "/")):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return f"{root}/warc-{uuid.uuid4().hex}"


def round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """Writes every page, reads every record back, and returns (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Bytes and digest are computed from the payloads read; a revisit has those of the response that it refers to.
    """
    folder = archive_folder(pages)
    records = read_records(write_archives(pages, folder, id_col, url_col, payload_col, min_bytes), folder)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = batch.column(4).to_pylist()
            if any(x is not None and digest(x) != d for x, d in zip(read, batch.column(3).to_pylist(), strict=True)):
                raise ValueError("a payload read back differs from its digest")
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array([None if x is None else len(x) for x in read], pa.int64())], names=[*batch.schema.names[:4], "payload_bytes"])

    found = cut(records.mapInArrow(measure, "page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"))
    fs, path = pafs.FileSystem.from_uri(folder)
    if fs.get_file_info(path).type == pafs.FileType.Directory:  # all records are read and kept above
        fs.delete_dir(path)
    revisits = found.filter("record_type = 'revisit'").drop("payload_bytes")
    wanted = revisits.select(F.col("refers_to").alias("_wanted")).distinct()
    full = found.filter("record_type = 'response'").join(wanted, F.col("page_id") == F.col("_wanted"), "left_semi").groupBy(F.col("page_id").alias("_id")).agg(F.max("payload_bytes").alias("payload_bytes"))
    revisits = revisits.join(full, F.col("refers_to") == F.col("_id"), "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.filter("record_type = 'response'").select(*columns).union(revisits.select(*columns))
