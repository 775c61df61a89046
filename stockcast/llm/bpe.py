"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can end its encoding. The encoder
stores that token per prefix. A token ``t`` that ends at ``i`` and starts at ``j`` is the one iff the
pair (last token of prefix ``j``, ``t``) is stable under the merge rules; walking the stored tokens
backwards gives the encoding. Storing them makes appends exact (only new prefixes are computed) and
lets an edit recompute only the prefixes near it.

Most pieces of a text are a few bytes long, and many are seen for the first time. Those of a group of texts are
merged together, by the definition below: arrays hold the pieces' tokens, and each round merges the best pair of every piece.

Semantics follow rank-based BPE: a piece that is a vocabulary entry is that token; else the adjacent
pair whose concatenation has the lowest rank merges first, the leftmost on ties.

Edge cases: null text encodes as the empty text (no tokens); repeated rows are encoded each; a null
``doc_id`` passes through; texts of any length are encoded whole; an empty table gives an empty result; other columns of
the input are not read, so they may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from public_tokenizers import PATTERN as SPACED
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .components import map_arrow, quoted

#: Parts of texts kept in a worker's table of encodings, and their greatest length in characters.
#: Both bound memory only: a part that is not kept is encoded again.
KEPT_CHUNKS, KEPT_CHARS, KEPT_PAIRS = 300_000, 40, 500_000

#: Characters of the texts that are encoded together, parts of one longer text that are, pieces of a block, and the greatest
#: lengths in bytes of a block's pieces (powers of two); longer pieces are encoded by prefixes.
GROUP_CHARS, GROUP_PARTS, BLOCK, WIDTHS = 1 << 18, 1 << 15, 2048, (8, 16, 32)

#: A space that begins a piece, and one that doesn't, in texts of the pattern SPACED.
CUT, UNCUT = re.compile(r"(?= \S)"), re.compile(r" (?:\s|\Z)")

#: No pair.
NONE = 1 << 62


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of ``base64(token) rank`` lines."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Vocabulary:
    """Ranks plus the lookups that the prefix table needs."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self.automaton = ahocorasick.Automaton()
        for t, r in ranks.items():
            self.automaton.add_word(t.decode("latin-1"), (len(t), r))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self._alone: dict[int, bool] = {}

    def merge(self, data: bytes) -> list[int]:
        """The encoding by definition, for strings of a few tokens: merge lowest ranks until none is left."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def alone(self, t: int) -> bool:
        """Whether merging the token's own bytes yields the token."""
        ok = self._alone.get(t)
        if ok is None:
            ok = self._alone[t] = self.merge(self.tokens[t]) == [t]
        return ok

    def stable(self, a: int, b: int) -> bool:
        """Whether ``a`` followed by ``b`` stays that pair when their bytes are merged together."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        ok = self.pairs[a << 32 | b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return ok


class PairTable:
    """Ranks of adjacent tokens, and the merging of many short pieces at once.

    Only for ranks that hold every single byte: then whatever a merge makes is a token.
    """

    def __init__(self, ranks: dict[bytes, int]):
        found = (x for t, r in ranks.items() for i in range(1, len(t)) if (a := t[:i]) in ranks and (b := t[i:]) in ranks for x in (ranks[a], ranks[b], r))
        left, right, rank = np.fromiter(found, np.int64).reshape(-1, 3).T
        self.base = max(ranks.values()) + 2  # so that -1, no token, makes no key
        order = np.argsort(left * self.base + right)
        self.keys, self.ranks = (left * self.base + right)[order], rank[order]
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        self.bytes = self.find(np.repeat(self.single, 256), np.tile(self.single, 256))

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, NONE if it doesn't merge."""
        if not len(self.keys):
            return np.full(len(left), NONE)
        wanted = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], NONE)

    def merge(self, pieces: list[bytes], width: int) -> list[bytes]:
        """The encodings, as int32, of pieces of 1 to width bytes. A column is a piece; the row below the last stands for what lies outside."""
        n, bits, rows = len(pieces), width.bit_length() - 1, np.arange(width)[:, None]
        raw = np.frombuffer(b"".join([p.ljust(width, b"\0") for p in pieces]), np.uint8).reshape(n, width).T.astype(np.int64)
        inside = rows < np.fromiter(map(len, pieces), np.int64, n)
        done = np.where(inside, self.single[raw], -1)
        tokens = np.vstack([done, np.full((1, n), -1)])
        after = np.repeat(np.arange(1, width + 2)[:, None], n, 1)
        before = np.repeat(np.append(width, np.arange(width))[:, None], n, 1)
        # rank and place of the pair that begins in a row, as one number: the least is the leftmost of the lowest rank
        best = np.full((width + 1, n), NONE)
        pair = self.bytes[raw[:-1] << 8 | raw[1:]]
        best[: width - 1] = np.where(inside[1:] & (pair < NONE), pair << bits | rows[:-1], NONE)
        columns = np.arange(n)
        while True:
            least = best.min(axis=0)
            open_ = np.flatnonzero(least < NONE)
            if 2 * len(open_) <= len(columns):
                done[:, columns] = tokens[:width]
                if not len(open_):
                    break
                columns, least, tokens, after, before, best = columns[open_], least[open_], *(a[:, open_] for a in (tokens, after, before, best))
                open_ = np.arange(len(columns))
            least = least[open_]
            at, token = least & (width - 1), least >> bits
            gone = after[at, open_]
            next_, previous = after[gone, open_], before[at, open_]
            tokens[at, open_], tokens[gone, open_], best[gone, open_] = token, -1, NONE
            after[at, open_], before[next_, open_] = next_, at
            pair = self.find(np.concatenate([tokens[previous, open_], token]), np.concatenate([token, tokens[next_, open_]]))
            place = np.concatenate([previous, at])
            best[place, np.concatenate([open_, open_])] = np.where(pair < NONE, pair << bits | place, NONE)
        held = done.T >= 0
        flat, ends = done.T[held].astype(np.int32).tobytes(), (4 * np.cumsum(held.sum(axis=1))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]  # noqa: B905


class PrefixEncoding:
    """One byte string with the last token of each of its prefixes; supports exact appends and edits."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data = vocabulary, b""
        self.last: list[int] = []
        self.append(data)

    def _extend(self, old: list[int] | None = None, shift: int = 0, settled: int = 0) -> int:
        """Computes the missing last tokens; with the old ones of an edited string, stops once they repeat."""
        v, last = self.vocabulary, self.last
        begun = done = len(last)
        base, same, pairs = max(0, done - v.longest + 1), 0, v.pairs
        for end, (n, t) in v.automaton.iter(self.data[base:].decode("latin-1")):
            if end + base < done:  # known, or found just now
                continue
            start = end + base - n
            if start >= 0:
                ok = pairs.get(last[start] << 32 | t)
                if ok is None:
                    ok = v.stable(last[start], t)
            else:
                ok = start == -1 and v.alone(t)
            if ok:
                last.append(t)
                done += 1
                if old is not None and done > settled:
                    same = same + 1 if old[done - 1 - shift] == t else 0
                    if same >= v.longest:
                        break
        return done - begun

    def append(self, more: bytes) -> None:
        self.data += more
        self._extend()

    def edit(self, start: int, stop: int, new: bytes) -> int:
        """Replaces data[start:stop]; returns how many prefixes were computed anew.

        Beyond the edit, once as many consecutive prefixes as the longest token is long have the
        token that they had before, all later ones have too.
        """
        old, shift = self.last, len(new) - (stop - start)
        self.data = self.data[:start] + new + self.data[stop:]
        self.last = old[:start]
        computed = self._extend(old, shift, start + len(new))
        self.last += old[len(self.last) - shift :]
        return computed

    def ids(self) -> list[int]:
        """The encoding of the whole string."""
        out, i, tokens = [], len(self.data), self.vocabulary.tokens
        if (whole := self.vocabulary.ranks.get(self.data)) is not None:
            return [whole]
        while i > 0:
            t = self.last[i - 1]
            out.append(t)
            i -= len(tokens[t])
        return out[::-1]


class Codec:
    """Encodes texts part by part and decodes ids; holds a bounded table of parts already encoded."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        compiled = regex.compile(pattern)
        self.vocabulary = Vocabulary(ranks)
        self.split = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.spaced = pattern == SPACED
        self.pairs = PairTable(ranks) if all(bytes([b]) in ranks for b in range(256)) else None
        self._whole = {t: np.int32(r).tobytes() for t, r in ranks.items()}
        self._chunks: dict[str, bytes] = {}  # int32 each

    def _parts(self, text: str) -> list[str]:
        """With the pattern SPACED, a space before a character that isn't white space always begins a piece: texts are cut there
        first. With any other, the pattern alone says where pieces are."""
        if not self.spaced:
            return self.split(text)
        if "\0" in text or UNCUT.search(text):
            return CUT.split(text)
        return text.replace(" ", "\0 ").split("\0")

    def _encode(self, pieces: set[str]) -> Iterator[tuple[str, bytes]]:
        """Each piece with its encoding."""
        short: dict[int, tuple[list[str], list[bytes]]] = {w: ([], []) for w in WIDTHS}
        small, middle, large = WIDTHS
        for p in pieces:
            data = p.encode()
            whole = self._whole.get(data)
            if whole is not None:
                yield p, whole
            elif self.pairs is None or len(data) > large:
                yield p, np.array(PrefixEncoding(self.vocabulary, data).ids(), np.int32).tobytes()
            else:
                names, block = short[small if len(data) <= small else middle if len(data) <= middle else large]
                names.append(p)
                block.append(data)
        for width, (names, block) in short.items():
            for at in range(0, len(names), BLOCK):
                yield from zip(names[at : at + BLOCK], self.pairs.merge(block[at : at + BLOCK], width), strict=True)

    def _learn(self, parts: set[str]) -> list[str]:
        """Puts parts into the table and returns the long ones. With the pattern SPACED, a word of ASCII letters is one piece; a piece by itself is cut into no others."""
        known = self._chunks
        mixed = {p: self.split(p) for p in parts if not (p.isascii() and p[1:].isalpha() and (p[0] == " " or p[0].isalpha()))} if self.spaced else {}
        pieces = parts.difference(mixed).union(*mixed.values()).difference(known)
        known.update(self._encode(pieces))
        known.update((p, b"".join([known[x] for x in cut])) for p, cut in mixed.items() if len(cut) != 1)
        return [p for p in chain(pieces, mixed) if len(p) > KEPT_CHARS]

    def _joined(self, cut: list[list[str]]) -> list[bytes]:
        """The encoding of each list of parts; new parts of all are encoded together."""
        parts = set(chain.from_iterable(cut))
        new = parts.difference(self._chunks)
        if len(self._chunks) + len(new) > KEPT_CHUNKS:
            self._chunks.clear()
            new = parts
        long = self._learn(new)
        out = [b"".join(map(self._chunks.__getitem__, c)) for c in cut]
        for p in long:
            self._chunks.pop(p, None)
        return out

    def encode_all(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, int32, from groups of texts."""
        at = 0
        while at < len(texts):
            begin, size = at, 0
            while at < len(texts) and (at == begin or size + len(texts[at]) <= GROUP_CHARS):
                size += len(texts[at])
                at += 1
            cut = [self._parts(t) for t in texts[begin:at]]
            if size > GROUP_CHARS:  # one text
                (parts,) = cut
                found = [b"".join([self._joined([parts[k : k + GROUP_PARTS]])[0] for k in range(0, len(parts), GROUP_PARTS)])]
            else:
                found = self._joined(cut)
            yield from (np.frombuffer(x, np.int32) for x in found)

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text])).tolist()

    def decode(self, ids: list[int]) -> bytes:
        tokens = self.vocabulary.tokens
        return b"".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process and vocabulary file."""
    return Codec(load_ranks(path), pattern)


def encode_documents(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True
) -> DataFrame:
    """Encodes and decodes every whole text.

    Returns id_col, n_tokens, ids (array of int, if keep_ids), ids_sha256 (of the decimal ids joined by
    commas) and decoded_sha256 (of the bytes that decoding the ids gives). The vocabulary file is read by
    each worker; its path must exist on every machine.
    """
    fields = [("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    fields = [f for f in fields if keep_ids or f[0] != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path, pattern)
        text_of = {t: str(t) for t in c.vocabulary.tokens}
        for batch in batches:
            out: dict[str, list] = {k: [] for k, _ in fields}
            for ids in map(np.ndarray.tolist, c.encode_all([text or "" for text in batch.column(1).to_pylist()])):
                out["n_tokens"].append(len(ids))
                if keep_ids:
                    out["ids"].append(ids)
                out["ids_sha256"].append(hashlib.sha256(",".join([text_of[i] for i in ids]).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(out[k], t) for k, t in fields)], names=[id_col, *out])

    source = docs.select(quoted(id_col), quoted(text_col))
    added = "n_tokens long, " + "ids array<int>, " * keep_ids + "ids_sha256 string, decoded_sha256 string"
    return map_arrow(source, run, T.StructType([source.schema[0], *T._parse_datatype_string(added)]))
