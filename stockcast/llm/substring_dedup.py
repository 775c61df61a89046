"""Removal of byte strings that also start in a document with a smaller id (suffix-array style dedup).

Whole texts are packed into chunks of about CHUNK bytes. Every window of ``length`` bytes has an anchor, the
leftmost of its q-grams with the least hash; equal windows have equal anchors at equal offsets, and
neighbouring windows mostly share one, so about one position in 14 is an anchor.

1. Each chunk sends the hashes of its anchors, four bytes each, to hash buckets; a bucket sends back those
   that another chunk sent too. Anchors that occur in one chunk and one document only end here.
2. For the others the chunk sends the bytes of the windows that the anchor owns. If several documents of the
   chunk hold the very same bytes there, only the least id sends them: the others are settled, so a passage
   that many documents share leaves a chunk once. Where a passage begins or ends the bytes around it differ,
   so there every document has a record of its own: an anchor that leaves more than ``heavy`` different records
   in some chunk is cut into single windows everywhere. Those are settled in the chunk in their turn, and go to buckets by
   the hash of the window instead of the anchor's.
3. A bucket refines the windows by bucket pointers: positions start in buckets of equal 8-grams, and
   buckets are split by sorting on the bucket of the position 8, then 16, then ``length - 32`` further on, each
   time reusing the buckets found just before. At the full length, a window is removed if its bucket has a
   smaller id. Equality is of bytes, not of hashes.
4. Chunks gather the removed windows and cut them out.

Edge cases: null text is the empty text; texts shorter than ``length`` lose nothing; equal texts lose all but
that of the least id; rows that repeat an id don't count as smaller than each other; a null id counts as
larger than all others, as does 2^63 - 1, which stands for it; strings never cross documents; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut, quoted

LENGTH, GRAM, CHUNK = 50, 24, 4_000_000
#: Bytes of candidate text that a bucket refines at a time; what shares an anchor is never split.
REFINED = 4_000_000
#: Different records of one anchor in a chunk beyond which the anchor's windows are sent one by one.
HEAVY = 64
_NULL_ID = np.iinfo(np.int64).max
#: Odd multipliers of the hash.
_K = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_RECORD = np.dtype([("id", "<i8"), ("row", "<u4"), ("start", "<u4"), ("left", "u1"), ("windows", "u1")])
_SPAN = np.dtype([("row", "<u4"), ("start", "<u4"), ("end", "<u4")])


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as a number; data has eight spare bytes at its end."""
    return np.ndarray((max(0, len(data) - 7),), np.uint64, buffer=data, strides=(1,))


def gram_hash(w: np.ndarray, at: np.ndarray | slice, gram: int = GRAM) -> np.ndarray:
    """64-bit hashes of the gram-byte strings (16 to 24 bytes) from the given positions; never 0."""
    shift = (lambda k: slice(at.start + k, at.stop + k)) if isinstance(at, slice) else (lambda k: at + k)
    h = w[at] * _K[0]
    h += w[shift(8)] * _K[1]
    h += w[shift(gram - 8)] * _K[2]
    h ^= h >> np.uint64(29)
    h *= _K[3]
    h ^= h >> np.uint64(32)
    h |= np.uint64(1)
    return h


def slide(a: np.ndarray, width: int, op: np.ufunc) -> np.ndarray:
    """op over each run of width elements."""
    span = 1
    while span * 2 <= width:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (width - span)], a[width - span :]) if span < width else a


class Chunk:
    """Texts of several documents end to end."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, data: np.ndarray):
        self.ids, self.data = ids, data  # data has spare bytes at its end
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.n = int(sizes.sum())

    @classmethod
    def unpack(cls, ids: bytes, sizes: bytes, text: bytes) -> Chunk:
        raw = zstandard.ZstdDecompressor().decompress(text)
        return cls(np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int64), np.frombuffer(raw, np.uint8))

    def anchors(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(positions, hashes) of the anchors of all windows."""
        w = words(self.data)
        width = length - GRAM + 1
        last = self.n - length  # the last window
        if last < 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        low = (gram_hash(w, slice(0, self.n - GRAM + 1)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = slide(low, width, np.minimum)[: last + 1]
        edge = np.zeros(self.n + 1, np.int32)  # windows that would leave their document have no anchor
        np.add.at(edge, np.maximum(self.starts, self.ends - length + 1), 1)
        np.add.at(edge, self.ends, -1)
        least[np.cumsum(edge)[: last + 1] > 0] = 0
        cover = slide(np.concatenate([np.zeros(width - 1, np.uint32), least, np.zeros(width - 1, np.uint32)]), width, np.maximum)
        at = np.flatnonzero(low[: len(cover)] == cover[: len(low)])
        return at, gram_hash(w, at)

    def owned(self, at: np.ndarray, hashes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, first window, last window) of each anchor."""
        width = length - GRAM + 1
        low = (hashes >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        row = np.searchsorted(self.ends, at, side="right")
        first = np.maximum(self.starts[row], at - width + 1)
        last = np.minimum(at, self.ends[row] - length)
        for side in (-1, 1):
            todo, step = np.arange(len(at)), 0
            while len(todo):
                step += side
                other = todo + step
                todo, other = todo[(other >= 0) & (other < len(at))], other[(other >= 0) & (other < len(at))]
                inside = (at[todo] - at[other] < width) if side < 0 else (at[other] - at[todo] < width)
                todo, other = todo[inside], other[inside]
                if side < 0:
                    stops = low[other] <= low[todo]
                    first[todo[stops]] = np.maximum(first[todo[stops]], at[other[stops]] + 1)
                else:
                    stops = low[other] < low[todo]
                    last[todo[stops]] = np.minimum(last[todo[stops]], at[other[stops]] - width)
                todo = todo[~stops]
        return row, first, last

    def records(self, at: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty(len(at), _RECORD)
        out["id"], out["row"], out["start"] = self.ids[row], row, first - self.starts[row]
        out["left"], out["windows"] = at - first, last - first + 1
        return out

    def heavy(self, at: np.ndarray, hashes: np.ndarray, length: int, most: int) -> np.ndarray:
        """Hashes of the anchors that have more than most records with different bytes."""
        code, times = np.unique(hashes, return_counts=True)
        often = code[times > most]
        if not len(often):
            return often
        row, first, last = self.owned(at, hashes, length)
        picked = np.flatnonzero((first <= last) & np.isin(hashes, often))
        row, first, last, at = (x[picked] for x in (row, first, last, at))
        left = ~outdone(self.records(at, row, first, last), self.data, first, at, length)
        code, times = np.unique(hashes[picked][left], return_counts=True)
        return code[times > most]


def take_runs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """data[start : start + size] of each run, end to end."""
    ends = np.cumsum(sizes)
    return data[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


def single_windows(records: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each window of the records as a record of its own, with its position."""
    sizes = records["windows"].astype(np.int64)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.repeat(records, sizes)
    out["start"] += place.astype(np.uint32)
    out["left"] -= place.astype(np.uint8)
    out["windows"] = 1
    return out, np.repeat(first, sizes) + place


def _marked(marked: np.ndarray, every: np.ndarray) -> bytes:
    """Two arrays of one type, the former's length before them."""
    return np.array([len(marked)], every.dtype).tobytes() + marked.astype(every.dtype).tobytes() + every.tobytes()


def _unmarked(blob: bytes, kind: type) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(blob, kind)
    return data[1 : int(data[0]) + 1], data[int(data[0]) + 1 :]


def bucket_ids(key: np.ndarray) -> np.ndarray:
    """Equal keys get equal ids, in the order of the keys."""
    return np.unique(key, return_inverse=True)[1].astype(np.uint64)


def refine(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(run, bucket) of every window of length bytes (33 to 64) within the runs; equal windows have equal buckets.

    Positions hold the bucket of the 8-, 16- and 32-gram that starts at them in turn. Positions too near
    the end of their run for the next gram fall out.
    """
    spare = np.concatenate([data, np.zeros(8, np.uint8)])
    run = np.repeat(np.arange(len(sizes)), sizes)
    to_end = np.repeat(starts + sizes, sizes) - np.arange(len(run)) if len(run) else run
    bucket = np.zeros(len(run), np.uint64)
    at = np.flatnonzero(to_end >= 8)
    bucket[at] = bucket_ids(words(spare)[at])
    for ahead, reach in ((8, 16), (16, 32), (length - 32, length)):
        at = np.flatnonzero(to_end >= reach)
        bucket[at] = bucket_ids(bucket[at] << np.uint64(32) | bucket[at + ahead])
    return run[at], bucket[at]


def may_match(records: np.ndarray, text: np.ndarray, starts: np.ndarray, hashes: np.ndarray, length: int) -> np.ndarray:
    """Whether a record can share a window with one of another id: the first splitting of the anchor buckets.

    A window has length - GRAM bytes beside its anchor, so half of them on one side: records that share
    neither the anchor with the bytes on its left nor with those on its right have no window in common.
    """
    side = min(16, (length - GRAM + 1) // 2)
    if side < 8:
        return np.ones(len(records), bool)
    w, at = words(text), starts + records["left"]
    ends = starts + records["windows"].astype(np.int64) + length - 1
    out = np.zeros(len(records), bool)
    for enough, near, far in ((records["left"] >= side, at - side, at - 8), (at + GRAM + side <= ends, at + GRAM, at + GRAM + side - 8)):
        rows = np.flatnonzero(enough)
        key = hashes[rows] * _K[1] + w[near[rows]] * _K[0] + w[far[rows]] * _K[2]
        order = np.argsort(key ^ key >> np.uint64(31))
        if len(order):
            sorted_key = key[order]
            new = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
            owner = records["id"][rows[order]]
            several = np.minimum.reduceat(owner, new) < np.maximum.reduceat(owner, new)
            out[rows[order]] |= np.repeat(several, np.diff(np.append(new, len(order))))
    return out


def outdone(records: np.ndarray, data: np.ndarray, first: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Whether a record with a smaller id has the very same bytes around the same anchor: all its windows go."""
    sizes = records["windows"].astype(np.int64) + length - 1
    span = np.arange(2 * length - GRAM) - (length - GRAM)
    padded = np.zeros((len(records), (len(span) + 9) // 8 * 8), np.uint8)
    for a in range(0, len(records), 65_536):
        part = slice(a, a + 65_536)
        place = at[part, None] + span
        inside = (place >= first[part, None]) & (place < (first + sizes)[part, None])
        padded[part, : len(span)] = np.where(inside, data[np.where(inside, place, 0)], 0)
    padded[:, -1] = records["left"] + np.uint8(1)
    padded[:, -2] = records["windows"]
    order, fresh = _grouped(padded.view(np.uint64))
    new = np.flatnonzero(fresh)
    out = np.zeros(len(order), bool)
    if len(order):
        least = np.repeat(np.minimum.reduceat(records["id"][order], new), np.diff(np.append(new, len(order))))
        out[order] = records["id"][order] > least
    return out


def removed_windows(records: np.ndarray, data: np.ndarray, length: int) -> np.ndarray:
    """For each window of the records, in order, whether a record with a smaller id has it too."""
    sizes = records["windows"].astype(np.int64) + length - 1
    run, bucket = refine(data, np.cumsum(sizes) - sizes, sizes, length)
    owner = records["id"][run]
    order = np.argsort(bucket, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], bucket[order][1:] != bucket[order][:-1]])) if len(order) else order
    least = np.minimum.reduceat(owner[order], new) if len(order) else owner
    out = np.empty(len(order), bool)
    out[order] = owner[order] > np.repeat(least, np.diff(np.append(new, len(order))))
    return out


def pack(docs: DataFrame, id_col: str, text_col: str, chunk: int) -> DataFrame:
    """(chunk, ids, sizes, text): documents of about chunk bytes, compressed, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, texts, held = TaskContext.get().partitionId() << 32, [], [], 0
        squeeze = zstandard.ZstdCompressor(level=3)

        def row() -> pa.RecordBatch:
            parts = [np.array(ids, np.int64).tobytes(), np.array([len(t) for t in texts], np.int64).tobytes(), squeeze.compress(b"".join(texts) + bytes(8))]
            return pa.RecordBatch.from_arrays([pa.array([number]), *(pa.array([p], pa.binary()) for p in parts)], names=["chunk", "ids", "sizes", "text"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                data = (t.as_py() or "").encode()
                ids.append(_NULL_ID if i.as_py() is None else i.as_py())
                texts.append(data)
                held += len(data)
                if held >= chunk:
                    yield row()
                    number, ids, texts, held = number + 1, [], [], 0
        if ids:
            yield row()

    packed = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(run, "chunk long, ids binary, sizes binary, text binary")
    return cut(packed)


def _shared_anchors(packed: DataFrame, buckets: int, length: int, most: int) -> DataFrame:
    """(chunk, found): the chunk's anchor codes that other chunks have too, those heavy in any chunk marked, as one array of blobs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, *parts in zip(*batch.columns, strict=True):
                chunk = Chunk.unpack(*(p.as_py() for p in parts))
                at, hashes = chunk.anchors(length)
                code, heavy = np.unique(hashes), chunk.heavy(at, hashes, length, most)
                bucket, low = code % np.uint64(buckets), (code // np.uint64(buckets)).astype(np.uint32)
                order = np.lexsort((low, bucket))
                bucket, low, mark = bucket[order], low[order], np.isin(code, heavy, assume_unique=True)[order]
                edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, int)
                blobs = [_marked(low[a:b][mark[a:b]], np.unique(low[a:b])) for a, b in zip(edges, edges[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]].astype(np.int64)), pa.array([number.as_py()] * len(blobs), pa.int64()), pa.array(blobs, pa.binary())], names=["bucket", "chunk", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, blobs in _groups(batches):
            marks, arrays = zip(*(_unmarked(b, np.uint32) for b in blobs), strict=True)
            marked = np.unique(np.concatenate(marks))
            every = np.sort(np.concatenate(arrays))
            twice = np.unique(every[1:][every[1:] == every[:-1]])
            out = []
            for number, a in zip(chunks, arrays, strict=True):
                found = a[np.isin(a, twice, assume_unique=True)]
                if len(found):
                    codes = found.astype(np.uint64) | np.uint64(bucket) << np.uint64(32)
                    out.append((number, _marked(codes[np.isin(found, marked, assume_unique=True)], codes)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], names=["chunk", "blob"])

    sent = packed.mapInArrow(send, "bucket long, chunk long, blob binary").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return sent.mapInArrow(meet, "chunk long, blob binary").groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list("blob").alias("found"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """(bucket, chunks, blobs) of sorted (bucket, chunk, blob) rows."""
    key, chunks, blobs = None, [], []
    for batch in batches:
        for bucket, number, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != key and blobs:
                yield key, chunks, blobs
                chunks, blobs = [], []
            key = bucket
            chunks.append(number)
            blobs.append(blob)
    if blobs:
        yield key, chunks, blobs


def _spans(records: np.ndarray, gone: np.ndarray, length: int) -> np.ndarray:
    """Spans of bytes covered by removed windows, window runs merged within each record."""
    sizes = records["windows"].astype(np.int64)
    run = np.repeat(np.arange(len(records)), sizes)
    place = np.arange(len(run)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.concatenate([[False], gone[:-1] & (run[1:] == run[:-1])]) if len(run) else gone
    after = np.concatenate([gone[1:] & (run[1:] == run[:-1]), [False]]) if len(run) else gone
    a, b = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after)
    out = np.empty(len(a), _SPAN)
    out["row"], out["start"] = records["row"][run[a]], records["start"][run[a]] + place[a]
    out["end"] = records["start"][run[b]] + place[b] + length
    return out


def _removed(packed: DataFrame, shared: DataFrame, buckets: int, length: int) -> DataFrame:
    """(chunk, spans): the removed spans of each chunk's documents, as an array of blobs."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for number, *parts, found in zip(*batch.columns, strict=True):
                chunk, rows = Chunk.unpack(*(p.as_py() for p in parts)), []
                at, hashes = chunk.anchors(length)
                row, first, last = chunk.owned(at, hashes, length)
                told = [_unmarked(b, np.uint64) for b in found.as_py() or []]
                known = np.sort(np.concatenate([np.empty(0, np.uint64), *(k for _, k in told)]))
                heavy = np.concatenate([np.empty(0, np.uint64), *(m for m, _ in told)])
                code = (hashes // np.uint64(buckets)).astype(np.uint32).astype(np.uint64) | (hashes % np.uint64(buckets)) << np.uint64(32)
                order = np.argsort(hashes, kind="stable")
                twin = np.zeros(len(at), bool)  # anchors that several documents of the chunk have
                if len(order):
                    new = np.flatnonzero(np.concatenate([[True], hashes[order][1:] != hashes[order][:-1]]))
                    several = np.maximum.reduceat(row[order], new) > np.minimum.reduceat(row[order], new)
                    twin[order] = np.repeat(several, np.diff(np.append(new, len(order))))
                spot = np.minimum(np.searchsorted(known, code), max(0, len(known) - 1))
                wanted = twin | (known[spot] == code) if len(known) else twin
                picked = np.flatnonzero(wanted & (first <= last))  # of equal hashes in a window only the first owns it
                row, first, last, at, hashes, code = (x[picked] for x in (row, first, last, at, hashes, code))
                record = chunk.records(at, row, first, last)
                if len(record):
                    keep = ~outdone(record, chunk.data, first, at, length)
                    done, bucket = record[~keep], hashes % np.uint64(buckets)
                    single = keep & np.isin(code, heavy)
                    keep &= ~single
                    window, spot = single_windows(record[single], first[single])
                    again = outdone(window, chunk.data, spot, spot + window["left"], length)
                    done, window, spot = np.concatenate([done, window[again]]), window[~again], spot[~again]
                    w = words(chunk.data)
                    by_window = (gram_hash(w, spot) * _K[1] + gram_hash(w, spot + length - GRAM)) >> np.uint64(7)
                    record, first = np.concatenate([record[keep], window]), np.concatenate([first[keep], spot])
                    bucket = np.concatenate([bucket[keep], by_window % np.uint64(buckets)])
                    rows.append((-1 - number.as_py(), number.as_py(), _spans(done, np.ones(int(done["windows"].astype(np.int64).sum()), bool), length).tobytes()))
                    by = np.argsort(bucket, kind="stable")
                    record, first, bucket = record[by], first[by], bucket[by]
                    sizes = record["windows"].astype(np.int64) + length - 1
                    edges = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, int)
                    for a, b in zip(edges, edges[1:], strict=False):
                        data = take_runs(chunk.data, first[a:b], sizes[a:b])
                        rows.append((int(bucket[a]), number.as_py(), squeeze.compress(np.int64(b - a).tobytes() + record[a:b].tobytes() + data.tobytes())))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "blob"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, chunks, blobs in _groups(batches):
            if bucket < 0:
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], names=["chunk", "blob"])
                continue
            records, data, source = [], [], []
            for number, blob in zip(chunks, blobs, strict=True):
                raw = zstandard.ZstdDecompressor().decompress(blob)
                n = int(np.frombuffer(raw, np.int64, 1)[0])
                records.append(np.frombuffer(raw, _RECORD, n, 8))
                data.append(np.frombuffer(raw, np.uint8, offset=8 + n * _RECORD.itemsize))
                source.append(np.full(n, number))
            record, text, number = np.concatenate(records), np.concatenate([*data, np.zeros(8, np.uint8)]), np.concatenate(source)
            sizes = record["windows"].astype(np.int64) + length - 1
            starts = np.cumsum(sizes) - sizes
            hashes = gram_hash(words(text), starts + record["left"])
            some = np.flatnonzero(may_match(record, text, starts, hashes, length))
            record, number, starts, sizes, hashes = record[some], number[some], starts[some], sizes[some], hashes[some]
            share = hashes // np.uint64(buckets) % np.uint64(max(1, -(-int(sizes.sum()) // REFINED)))
            for s in np.unique(share):
                part = np.flatnonzero(share == s)
                # copies of the same bytes need no refinement: all but the least id's go at once
                copy = outdone(record[part], text, starts[part], starts[part] + record["left"][part], length)
                yield from _sent_back(record[part[copy]], number[part[copy]], None, length)
                part = part[~copy]
                gone = removed_windows(record[part], take_runs(text, starts[part], sizes[part]), length)
                yield from _sent_back(record[part], number[part], gone, length)

    joined = packed.join(shared, F.col("chunk") == F.col("_chunk"), "left").select("chunk", "ids", "sizes", "text", "found")
    sent = joined.mapInArrow(send, "bucket long, chunk long, blob binary").repartition("bucket").sortWithinPartitions("bucket", "chunk")
    return sent.mapInArrow(meet, "chunk long, blob binary").groupBy(F.col("chunk").alias("_chunk")).agg(F.collect_list("blob").alias("spans"))


def _sent_back(records: np.ndarray, number: np.ndarray, gone: np.ndarray | None, length: int) -> Iterator[pa.RecordBatch]:
    """(chunk, blob) rows of the spans that removed windows cover; without gone, all windows are removed."""
    if gone is None:
        gone = np.ones(int(records["windows"].astype(np.int64).sum()), bool)
    if gone.any():
        spans = _spans(records, gone, length)
        whose = np.repeat(number, _span_counts(records, gone))
        order = np.argsort(whose, kind="stable")
        edges = np.append(np.flatnonzero(np.concatenate([[True], whose[order][1:] != whose[order][:-1]])), len(order))
        out = [spans[order[a:b]].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(whose[order][edges[:-1]]), pa.array(out, pa.binary())], names=["chunk", "blob"])


def _grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, whether each row of it begins a group) that puts equal rows of a matrix of words together."""
    mixed = (keys * (_K[0] + 2 * np.arange(keys.shape[1], dtype=np.uint64) * _K[1])).sum(axis=1, dtype=np.uint64) if len(keys) else np.empty(0, np.uint64)
    order = np.argsort(mixed ^ mixed >> np.uint64(31), kind="stable")
    fresh = np.ones(len(order), bool)
    fresh[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    return order, fresh


def _span_counts(records: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """How many spans _spans makes of each record."""
    sizes = records["windows"].astype(np.int64)
    run = np.repeat(np.arange(len(records)), sizes)
    first = gone.copy()
    first[1:] &= ~(gone[:-1] & (run[1:] == run[:-1]))
    return np.bincount(run[first], minlength=len(records))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, chunk: int = CHUNK, heavy: int = HEAVY) -> DataFrame:
    """(id_col, n_bytes, n_removed, spans, kept): spans are the maximal removed byte ranges, kept the other bytes.

    length is 33 to 64.
    """
    if not 33 <= length <= 64:
        raise ValueError("length must be 33 to 64")
    packed = pack(docs, id_col, text_col, chunk)
    buckets = max(1, packed.count() // 2)
    spans = _removed(packed, _shared_anchors(packed, buckets, length, heavy), buckets, length)
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, *parts, blobs in zip(*batch.columns, strict=True):
                c = Chunk.unpack(*(p.as_py() for p in parts))
                found = np.frombuffer(b"".join(blobs.as_py() or []), _SPAN)
                depth = np.zeros(c.n + 1, np.int64)
                depth += np.bincount(c.starts[found["row"]] + found["start"], minlength=c.n + 1)
                depth -= np.bincount(c.starts[found["row"]] + found["end"], minlength=c.n + 1)
                gone = np.cumsum(depth)[: c.n] > 0
                total = np.concatenate([[0], np.cumsum(gone)])
                heads = np.append(gone, False)
                heads[1:] &= ~gone
                heads[c.starts] |= np.append(gone, False)[c.starts]
                tails = np.append(gone, False)
                tails[:-1] &= ~np.append(gone[1:], False)
                tails[np.maximum(c.ends, 1) - 1] |= np.append(gone, False)[np.maximum(c.ends, 1) - 1]
                begin, end = np.flatnonzero(heads[: c.n]), np.flatnonzero(tails[: c.n]) + 1
                cutpoints = np.searchsorted(begin, np.stack([c.starts, c.ends]))
                rows = []
                for k in range(len(c.ids)):
                    a, b = c.starts[k], c.ends[k]
                    x, y = cutpoints[:, k]
                    n = int(total[b] - total[a])
                    whole = c.data[a:b]
                    ranges = [{"start": int(s - a), "end": int(e - a)} for s, e in zip(begin[x:y], end[x:y], strict=True)] if n else []
                    rows.append((None if c.ids[k] == _NULL_ID else int(c.ids[k]), int(b - a), n, ranges, (whole[~gone[a:b]] if n else whole).tobytes()))
                for at in range(0, len(rows), 1024):
                    columns = zip(*rows[at : at + 1024], strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int64(), span_type, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[id_col, "n_bytes", "n_removed", "spans", "kept"])

    joined = packed.join(spans, F.col("chunk") == F.col("_chunk"), "left").select("chunk", "ids", "sizes", "text", "spans")
    return joined.mapInArrow(run, f"`{id_col}` long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary")
