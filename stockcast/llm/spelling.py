r"""Spelling variant grouping by rolling-hash deletion keys.

Words are the maximal runs of letters of all whole texts, A-Z lower-cased, of LEAST_LENGTH code points and LEAST_COUNT
occurrences at least. Two are near if they differ by one inserted, deleted or replaced code point. A word's form is its
most frequent near word, if that is FACTOR times as frequent; its root is where following forms ends.

A word's code points become numbers, of which prefix sums of powers give the polynomial hash of every prefix and suffix and so,
in whole numpy arrays, of the word without any one code point. Two words of one length that differ in one place have the same key
there; a word equals a longer one without one code point if its own key is among the longer one's. Keys carry their place in
the former case, so all words under a key are near to each other, and are one for each letter at most; in the latter all
but one are near to that one. No pairs are made: each member of a group gets the size of the group and its best member.

Keys are dealt to tasks by their upper bits and sorted there as integers. Those of groups (a replacement with two words, a
word with a longer one) are kept, get their words by a join, and are sorted once more, by key, frequency and word: then strings decide who
is in a group, and hashes only what is compared. Every pair of near words meets under one key alone, so counts are sums.

What is shuffled grows with the different words and their lengths, not with occurrences: each task adds up its own first.

Edge cases: null and empty texts have no words; a null id is an empty one where misspellings are planted; repeated rows
count again; equal frequencies go by code points; words of any length are read whole, and a key is 25 bytes whatever the
length; an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import cut, quoted

#: What a word consists of, the least length and occurrences of a word, and how much more frequent a form is.
RUN, LEAST_LENGTH, LEAST_COUNT, FACTOR = re.compile("[A-Za-zÀ-ÿ]+"), 5, 3, 2
#: Fixed value: one run in so many loses a code point.
PLANTED = 97
#: Different runs that a task counts before it sends them on; code points of a text whose runs are listed at once.
HELD, LISTED = 400_000, 1 << 20
#: Words that one task makes keys of, about, and tasks at most.
EXPANDED, MOST_TASKS = 16_384, 4000
#: Upper bits of a key that deal it to a task; code points whose keys are made at once.
RADIX, AT_ONCE = 16, 1 << 18

_LOWER = {k: k + 32 for k in range(65, 91)}
_BASE = np.uint64(xxhash.xxh64_intdigest("base", 42) | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_LETTERS = np.array([xxhash.xxh64_intdigest(chr(k), 42) | 1 for k in range(256)], np.uint64)


def misspelt(name: object, word: str) -> str:
    """The word, without one code point if the checksum of id and word says so."""
    h = zlib.crc32(f"{'' if name is None else name}:{word}".encode())
    if h % PLANTED:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): all words, with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: Counter[str] = Counter()
                whole = text.as_py() or ""
                runs = RUN.findall(whole) if len(whole) < LISTED else (m[0] for m in RUN.finditer(whole))
                for raw, n in Counter(runs).items():
                    own[raw.lower() if raw.isascii() else raw.translate(_LOWER)] += n
                for word, n in own.items():
                    if len(found := misspelt(name, word)) >= LEAST_LENGTH:
                        held[found] += n
                if len(held) >= HELD:
                    yield told()
        yield told()

    source = docs.select(F.col(quoted(id_col)).cast("string").alias("c0"), F.col(quoted(text_col)).alias("c1"))
    return source.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every bit of the result depends on all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, row, place) of each key of each word: row is an index of words.

    The lowest bit of a key is 1 for replacements, whose place is the one left out, and 0 for deletions: place is the first of
    the equal code points of which one is left out, or -1 for the key of the whole word.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lengths = np.array([len(w) for w in words])
    row = np.repeat(np.arange(len(words)), lengths)
    starts = np.cumsum(lengths) - lengths
    place = np.arange(len(codes)) - starts[row]
    powers = np.ones(int(lengths.max(initial=0)) + 1, np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTERS[codes & 255] * powers[place], dtype=np.uint64)])
    before, after, first, last = sums[:-1], sums[1:], sums[starts], sums[starts + lengths]
    rest = (before - first[row]) + (last[row] - after) * _INVERSE  # all that is left moves one place on
    tag, bit = mixed(place.astype(np.uint64) + np.uint64(1)), np.uint64(1)
    replaced = mixed(rest ^ tag) | bit
    distinct = np.ones(len(codes), bool)
    distinct[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    deleted = mixed(rest[distinct]) & ~bit
    whole = mixed(last - first) & ~bit
    keys = np.concatenate([replaced, deleted, whole]).view(np.int64)
    return keys, np.concatenate([row, row[distinct], np.arange(len(words))]), np.concatenate([place, place[distinct], np.full(len(words), -1)])


def _keys(words: DataFrame) -> DataFrame:
    """(radix, key, id, place) of (id, word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            ends = np.cumsum([len(w) for w in texts])
            at = 0
            while at < len(texts):
                stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, side="right")))
                key, row, place = deletion_keys(texts[at:stop])
                for k in range(0, len(key), AT_ONCE):
                    part = slice(k, k + AT_ONCE)
                    radix = (key[part].view(np.uint64) >> np.uint64(64 - RADIX)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (radix, key[part], ids[at:stop][row[part]], place[part].astype(np.int32))], names=["radix", "key", "id", "place"])
                at = stop

    tasks = max(1, min(MOST_TASKS, -(-words.count() // EXPANDED)))  # a number, as few bytes become many keys
    return words.select("id", "word").repartition(tasks).mapInArrow(run, "radix int, key long, id long, place int")


def _grouped(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by a key column, cut so that no group of equal keys is in two."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.asarray(batch.column(key))
        changes = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = []
        if len(changes):
            held.append(batch.slice(0, int(changes[-1])))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held = [batch.slice(int(changes[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _starts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each group of equal keys starts, and its size."""
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.diff(np.append(starts, len(keys)))


def _live(keys: DataFrame) -> DataFrame:
    """The keys of groups that can hold near words: replacements of two or more, a whole word with deletions of others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 1):
            key, place = np.asarray(batch.column(1)), np.asarray(batch.column(3))
            starts, sizes = _starts(key)
            wholes = np.add.reduceat((place < 0).astype(np.int64), starts)
            live = (sizes > 1) & ((key[starts] & 1 == 1) | ((wholes > 0) & (wholes < sizes)))
            if live.any():
                yield batch.filter(pa.array(np.repeat(live, sizes))).select(["key", "id", "place"])

    return keys.repartition("radix").sortWithinPartitions("key").mapInArrow(run, "key long, id long, place int")


def _near_in_groups(rows: DataFrame) -> DataFrame:
    """(id, n_near, best) of each word in each group of (radix, key, id, place, word, n); best is (-n, word, id)."""

    def emit(base: list[str], place: np.ndarray, sub: bool, at: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(row, near words, best row) of the rows of one group, given by at, most frequent first; strings decide."""
        by: dict[str, list[int]] = {}
        for r in at.tolist():
            by.setdefault(base[r], []).append(r)
        for found in by.values():
            wholes = [r for r in found if place[r] < 0]
            others = [r for r in found if place[r] >= 0]
            if sub:
                same: dict[int, list[int]] = {}
                for r in others:
                    same.setdefault(int(place[r]), []).append(r)
                for m in same.values():
                    if len(m) > 1:
                        yield from ((r, len(m) - 1, m[1] if r == m[0] else m[0]) for r in m)
            elif wholes and others:
                yield (wholes[0], len(others), others[0])
                yield from ((r, 1, wholes[0]) for r in others)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _grouped(batches, 1):
            key, ids, place, n = (np.asarray(batch.column(k)) for k in (1, 2, 3, 5))
            words = batch.column(4).to_pylist()
            base = [w if p < 0 else w[:p] + w[p + 1 :] for w, p in zip(words, place.tolist(), strict=True)]
            starts, sizes = _starts(key)
            first = np.repeat(starts, sizes)
            sub = key & 1 == 1
            # groups whose strings all agree, and whose places do, are settled in arrays; the others one by one
            alike = np.array([b == base[f] for b, f in zip(base, first.tolist(), strict=True)], bool) & (~sub | (place == place[first]))
            wholes = np.add.reduceat((place < 0).astype(np.int64), starts)
            plain = np.logical_and.reduceat(alike, starts) & np.where(sub[starts], sizes > 1, (wholes == 1) & (sizes > 1))
            row, count, best = [], [], []
            for s, size in zip(starts[plain & sub[starts]].tolist(), sizes[plain & sub[starts]].tolist(), strict=True):
                row += range(s, s + size)
                count += [size - 1] * size
                best += [s + 1] + [s] * (size - 1)
            for s, size in zip(starts[plain & ~sub[starts]].tolist(), sizes[plain & ~sub[starts]].tolist(), strict=True):
                whole = s + int(np.argmax(place[s : s + size] < 0))
                row += range(s, s + size)
                count += [size - 1 if r == whole else 1 for r in range(s, s + size)]
                best += [(s if whole != s else s + 1) if r == whole else whole for r in range(s, s + size)]
            for k in np.flatnonzero(~plain):
                for r, c, b in emit(base, place, bool(sub[starts[k]]), np.arange(starts[k], starts[k] + sizes[k])):
                    row.append(r)
                    count.append(c)
                    best.append(b)
            if row:
                at = np.array(best)
                chosen = pa.StructArray.from_arrays([pa.array(-n[at]), batch.column(4).take(pa.array(at)), pa.array(ids[at])], names=["m", "word", "id"])
                yield pa.RecordBatch.from_arrays([pa.array(ids[np.array(row)]), pa.array(np.array(count, np.int64)), chosen], names=["id", "n_near", "best"])

    ordered = rows.select("radix", "key", "id", "place", "word", "n").repartition("radix").sortWithinPartitions("key", F.col("n").desc(), "word")
    return ordered.mapInArrow(run, "id long, n_near long, best struct<m: long, word: string, id: long>")


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, best) of the words of (id, word, n) that have near ones; best is (-n, word, id) of the most frequent."""
    live = _live(_keys(words))
    radix = F.shiftrightunsigned(F.col("key"), 64 - RADIX).cast("int").alias("radix")
    named = live.join(words, "id").select(radix, "key", "id", "place", "word", "n")
    return _near_in_groups(named).groupBy("id").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root), the last of each chain of (id, form), by doubling; forms at least double the frequency, so chains are short."""
    now = forms.select("id", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("id").alias("_id"), F.col("root").alias("_next"))
        moved = now.join(step, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        moved = cut(moved)
        now = moved.select("id", "root")
        if moved.filter("_moved").isEmpty():
            return now


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row per word."""
    words = cut(word_counts(docs, id_col, text_col).withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words)
    more = -F.col("best.m") >= FACTOR * F.col("n")
    found = words.join(near, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(more, F.col("best")).alias("best"))
    found = cut(found.select("id", "word", "n", "n_near", F.col("best.word").alias("form"), (-F.col("best.m")).alias("form_n"), F.col("best.id").alias("_form")))
    roots = _roots(found.filter("_form IS NOT NULL").select("id", F.col("_form").alias("form")))
    told = words.select(F.col("id").alias("_root"), F.col("word").alias("root"))
    named = roots.select("id", F.col("root").alias("_root")).join(told, "_root").select("id", "root")
    return found.join(named, "id", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
