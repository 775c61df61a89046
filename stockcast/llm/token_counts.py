"""Token counts per section by offset-mapped attribution.

A whole document is encoded once. Token lengths in bytes give each token's span, mapped to code points, and
a merge of the sorted token spans with the sorted section spans attributes each token. A token that
crosses a boundary is allocated by a rule: ``first`` gives it to the section that holds its first
character, ``share`` splits it over sections by the bytes that each holds. A character that several
tokens share counts as held by each of them.

Sections are given as an array of (name, start, end) spans in code points, or made by ``line_sections``.
Tokens in no section go to the section named by ``rest``, so that a document's sections sum to its tokens.

Edge cases: a null or empty text has no token and one empty ``rest`` row if it has no section; sections
that are empty or lie beyond the text count 0; spans that overlap each count the tokens that start in them
(``first``) or their shares; sections that are null or have a null bound are left out; repeated rows are counted each; a null id is a value;
an empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import codec
from .components import map_arrow, quoted

RULES = ("first", "share")


def line_sections(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of maximal runs of lines of one kind: list items, table rows, code or prose.

    A line ends with its newline; blank lines belong to the run before them.
    """
    out: list[tuple[str, int, int]] = []
    at = 0
    for line in text.split("\n"):
        end = min(len(text), at + len(line) + 1)
        bare = line.strip()
        kind = "table" if bare.count("|") >= 2 else "list" if bare[:2] in ("- ", "* ") else "code" if line[:4] == "    " or bare[-1:] in ("{", "}", ";") else "prose"
        if out and (not bare or out[-1][0] == kind):
            out[-1] = (out[-1][0], out[-1][1], end)
        elif end > at:
            out.append((kind if bare else "prose", at, end))
        at = end
    return out


def attribute(text: str, lengths: np.ndarray, sections: list[tuple[str, int, int]], rule: str) -> tuple[np.ndarray, float]:
    """Tokens of each section, and of none, from the tokens' lengths in bytes."""
    ends = np.cumsum(lengths)
    starts = ends - lengths
    if text.isascii():
        first = starts
        to_byte = None
    else:
        data = np.frombuffer(text.encode(), np.uint8)
        char_of = np.cumsum((data & 0xC0) != 0x80) - 1  # code point of each byte
        first = char_of[starts] if len(starts) else starts
        to_byte = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    bounds = np.array([(a, max(a, b)) for _, a, b in sections], np.int64).reshape(-1, 2).clip(0, len(text))
    if rule == "first":
        held = np.searchsorted(first, bounds)  # tokens whose first character lies before each bound
        counts = (held[:, 1] - held[:, 0]).astype(np.float64)
        inside = np.zeros(len(first) + 1, np.int64)
        np.add.at(inside, held[:, 0], 1)
        np.add.at(inside, held[:, 1], -1)
        return counts, float((np.cumsum(inside)[:-1] == 0).sum())
    edges = bounds if to_byte is None else to_byte[bounds]
    before = np.concatenate([[0.0], np.arange(1.0, len(ends) + 1)])  # tokens before each end
    points = np.concatenate([[0], ends])
    upto = np.interp(edges, points, before) if len(ends) else np.zeros(edges.shape)
    counts = upto[:, 1] - upto[:, 0]
    merged, reach = 0.0, 0.0
    for a, b in sorted(map(tuple, upto)):
        merged += max(0.0, b - max(a, reach))
        reach = max(reach, b)
    return counts, max(0.0, float(len(ends)) - merged)


def count_sections(
    docs: DataFrame, vocabulary_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", sections_col: str | None = None, rule: str = "first", rest: str = "rest"
) -> DataFrame:
    """(id_col, section, kind, start, end, n_tokens, doc_tokens), one row per section and one for what lies in none, if any.

    sections_col: an array of structs with the fields name, start and end, in any order and among others; without it, sections are runs of lines of a kind.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    names = [id_col, "section", "kind", "start", "end", "n_tokens", "doc_tokens"]
    source = docs.select(*(quoted(c) for c in (id_col, text_col, sections_col) if c))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path, pattern)
        size_of = np.zeros(max(c.vocabulary.tokens, default=0) + 1, np.int64)
        for t, data in c.vocabulary.tokens.items():
            size_of[t] = len(data)
        for batch in batches:
            at: list[int] = []
            rows: list[tuple] = []
            texts = [text or "" for text in batch.column(1).to_pylist()]
            for i, (text, ids) in enumerate(zip(texts, c.encode_all(texts), strict=True)):
                given = (batch.column(2)[i].as_py() or []) if sections_col else None
                sections = line_sections(text) if given is None else [(s["name"], s["start"], s["end"]) for s in given if s and s["start"] is not None and s["end"] is not None]
                lengths = size_of[ids]
                counts, none = attribute(text, lengths, sections, rule)
                found = [(k, *s, n) for k, (s, n) in enumerate(zip(sections, counts.tolist(), strict=True))]
                if none > 0 or not found:
                    found.append((len(found), rest, None, None, none))
                rows += [(*r, len(lengths)) for r in found]
                at += [i] * len(found)
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *map(pa.array, columns, kinds)], names=names)

    return map_arrow(source, run, T.StructType([source.schema[0], *T._parse_datatype_string("section long, kind string, start long, end long, n_tokens double, doc_tokens long")]))
