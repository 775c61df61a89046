r"""Secret scan: pattern spans plus assignment-aware lexing.

Three base patterns give spans of the kinds ``assign``, ``access`` and ``hex``. The method adds spans of
the kind ``literal``. Source and configuration syntax is lexed into (name, value) pairs:

- heads: ``name = value``, ``name: value``, ``:=``, ``=>``, ``==``, ``"name": value``, ``--name value``,
  ``<name>value</name>``, ``key="name" value="value"``, with blanks or tabs about the operator;
- values: quoted literals with escapes and string prefixes, triple quotes and backticks, literals joined by
  ``+``, ``.``, ``&`` or by standing side by side, lists and call arguments, YAML items and block scalars, bare literals;
- a key that opens an indented or braced block lends some of its weight to the keys in it.

A value that is a name assigned anywhere in the text is a reference. Weights of names run back along references
to a fixed point, whatever the order of the lines, so a literal is scored by the most sensitive name that it
flows to. The score is that weight times the randomness of the literal (of the joined one, if it is in pieces);
the pieces of literals at or above ``min_score`` become spans. Neither names nor literals have a greatest length.

Spans count code points, ends are exclusive. Edge cases: null text is the empty text; a text without
findings returns zero counts and empty lists; repeated rows are scanned each, whatever their ids; an empty
table gives an empty result; texts of any length are scanned whole, in time about linear in it; only the two
named columns of the input are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .components import map_arrow, quoted

#: Kinds in the order in which equal starts are listed.
KINDS = ("assign", "access", "hex", "literal")

#: The base patterns and the least lengths of a finding.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as a shorter run can't hold one
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Words of a name that make it sensitive, with weights.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "private": 0.7, "auth": 0.7, "authorization": 0.9, "bearer": 0.9, "signature": 0.6, "key": 0.6, "salt": 0.6,
}

#: A test that a text, without what separates the words of a name, can hold a sensitive name: every word above has one of these.
_HINT = re.compile("passw|pwd|passphrase|secret|token|api|credential|private|auth|bearer|signature|key|salt", re.IGNORECASE | re.ASCII)
_JOINTS = re.compile(r"[_.-]+")
#: What a key's weight counts for the keys of the block that it opens.
NESTED = 0.8

_HEAD = r"""(?:(?<![A-Za-z0-9_.-])(?P<name>[A-Za-z0-9_.-]++)|(?P<q>["'`])(?P<quoted>[A-Za-z0-9_.-]++)(?P=q))[\x20\t]*+(?P<op>:=|=>|[?+]=|={1,3}|:)[\x20\t]*+"""
_EVENT = re.compile(
    r"""\b(?:key|name|id)[\x20\t]*=[\x20\t]*(["'])(?P<attribute>[A-Za-z0-9_.-]++)\1[\x20\t]+(?:value|content)[\x20\t]*=[\x20\t]*(?=["'])"""
    r"""|(?<![A-Za-z0-9_-])--(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)[\x20\t]++(?=[^\s-])"""
    r"""|<(?P<tag>[A-Za-z_][A-Za-z0-9_.-]*+)>(?P<body>[^<\n]++)</(?P=tag)>"""
    rf"""|{_HEAD}|(?P<brace>[{{}}])|^(?P<item>[\x20\t]*-[\x20\t]+)""",
    re.MULTILINE,
)
_IS_HEAD = re.compile(_HEAD)
_STRING = re.compile(
    r"""(?:[rRbBuUfF]{1,2}(?=["']))?(?:\"""(?P<t>(?:[^"\\]|\\.|"(?!""))*+)\"""|\'\'\'(?P<u>(?:[^'\\]|\\.|'(?!''))*+)\'\'\'|"(?P<d>(?:[^"\\\n]|\\.)*+)"|'(?P<s>(?:[^'\\\n]|\\.)*+)'|`(?P<b>(?:[^`\\]|\\.)*+)`"""
    r"""|"(?P<e>[^"\n]*+)"|'(?P<f>[^'\n]*+)')""",
    re.DOTALL,
)
_BARE = re.compile(r"""(?:["'`]|(?:Bearer|Basic|Token)[\x20\t]+)?(?:\$\{(?P<named>[A-Za-z0-9_.-]+)\}|(?P<bare>[^\s"'`,;:<>(){}\[\]]++))""", re.IGNORECASE)
_JOIN = re.compile(r"""[\x20\t]*+(?:\r?\n[\x20\t]*+)?(?:\+[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?(?=["'`A-Za-z_$])|[.&][\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?(?=["'`]))|[\x20\t]*+\\\r?\n[\x20\t]*+(?=["'`])|[\x20\t]*+(?=["'])""")
_BLOCK = re.compile(r"[|>][+-]?[0-9]?[\x20\t]*\r?\n")
_LINE = re.compile(r"([\x20\t]*)([^\n]*?)[\x20\t\r]*(?:\n|\Z)")
_LEAD = re.compile(r"[\x20\t]*(?:-[\x20\t]+)?")
_SPACE = re.compile(r"\s+")
_END = re.compile(r"[\x20\t\r]*(?:#[^\n]*)?(?:\n|\Z)")
_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

#: A piece of a value: (start, end, the name that it may refer to, if it is bare).
Piece = tuple[int, int, str | None]


def sensitivity(name: str) -> float:
    """0 to 1: the largest weight of the words, singular or plural, of a snake, kebab, dotted or camel case name."""
    words = [w.lower() for w in _WORDS.findall(name)]
    pairs = [a + b for a, b in zip(words, words[1:], strict=False)]
    return max((max(SENSITIVE.get(w, 0.0), SENSITIVE.get(w.removesuffix("s"), 0.0)) for w in [*words, *pairs]), default=0.0)


def randomness(literal: str) -> float:
    """0 to 1: entropy per character against that of 16 equally likely ones, less for short literals."""
    n = len(literal)
    if n < LEAST_ASSIGN:
        return 0.0
    bits = -sum(c / n * math.log2(c / n) for c in Counter(literal).values())
    return min(1.0, bits / 4) * min(1.0, n / 12)


def _joined_pieces(text: str, at: int) -> tuple[list[Piece], int]:
    """The pieces of one value, joined by concatenation, and where it ends."""
    out: list[Piece] = []
    while True:
        if m := _STRING.match(text, at):
            out.append((*m.span(m.lastgroup), None))
        elif m := _BARE.match(text, at):
            group = m.lastgroup
            out.append((*m.span(group), m[group]))
        else:
            return out, at
        at = m.end()
        step = _JOIN.match(text, at)
        if not step or (step.end() == at and m.lastgroup in ("named", "bare")):
            return out, at
        at = step.end()


def _listed(text: str, at: int) -> tuple[list[list[Piece]], int]:
    """The elements of the list that opens at a bracket; it ends at the closing one, or before whatever is lexed by itself.

    So of many brackets that nothing closes, each is read to the next such place only. Quoted literals without a comma
    between them are pieces of one.
    """
    out: list[list[Piece]] = []
    depth, apart, event = 0, True, -1
    while at < len(text):
        c = text[at]
        if c in "[(":
            depth, at, apart = depth + 1, at + 1, True
        elif c in "])":
            depth, at = depth - 1, at + 1
            if depth == 0:
                break
        elif c == ",":
            at, apart = at + 1, True
        elif m := _SPACE.match(text, at):
            at = m.end()
            if text[at : at + 2] in ("- ", "-\t") and "\n" in m[0]:
                break
        else:
            pieces, end = ([], at) if _EVENT.match(text, at) else _joined_pieces(text, at)
            if not pieces:
                break
            if event < at:
                event = m.start() if (m := _EVENT.search(text, at)) else len(text)
            if any(word is not None and a <= event < b for a, b, word in pieces):
                out.append(pieces)
                break
            if apart or pieces[0][2] is not None:
                out.append(pieces)
            else:
                out[-1] += pieces
            at, apart = end, pieces[-1][2] is not None
    return out, at


def _block(text: str, at: int, indent: int) -> list[Piece]:
    """The lines of a block scalar, deeper than its key."""
    out: list[Piece] = []
    while at < len(text):
        m = _LINE.match(text, at)
        if m[2] and len(m[1]) <= indent:
            break
        if m[2]:
            out.append((*m.span(2), None))
        at = m.end()
    return out


def _values(text: str, at: int) -> tuple[list[list[Piece]], int]:
    """The values that begin at a position: one, or those of a list or a call; and where to lex on.

    What is enclosed is lexed again for the pairs in it.
    """
    if text[at : at + 1] in ("[", "("):
        return _listed(text, at)[0], at + 1
    pieces, end = _joined_pieces(text, at)
    if pieces and pieces[-1][2] is not None and text[end : end + 1] == "(":
        return [*_listed(text, end)[0]], end + 1
    return [pieces] if pieces else [], (at + 1 if pieces and pieces[0][2] is None else end)


def lex(text: str) -> list[tuple[str, float, list[list[Piece]]]]:
    """(name, weight, values) of each pair, by position; the weight is of the name and of the blocks about it."""
    out: list[tuple[str, float, list[list[Piece]]]] = []
    frames: list[tuple[int, str, float]] = []  # (indentation, or -1 for a brace; key; weight) of the open blocks
    opens: tuple[int, str, float] | None = None  # where a brace would belong to the last head
    at = line = seen = 0
    lead = _LEAD.match(text)
    while m := _EVENT.search(text, at):
        start, at = m.start(), m.end()
        if (newline := text.rfind("\n", seen, start)) >= 0:
            line = newline + 1
            lead = _LEAD.match(text, line)
        seen = start
        if m["brace"] == "{":
            name, weight = opens[1:] if opens and opens[0] == start else frames[-1][1:] if frames else ("", 0.0)
            frames.append((-1, name, weight))
            continue
        if m["brace"]:
            while frames and frames.pop()[0] >= 0:
                pass
            continue
        indent = lead.end() - line if lead.end() == start else len(m["item"].rstrip(" \t")) - 1 if m["item"] else None
        if indent is not None:
            while frames and (frames[-1][0] > indent if m["item"] else frames[-1][0] >= indent):
                frames.pop()
        _, outer, around = frames[-1] if frames else (0, "", 0.0)
        if m["item"]:
            if frames and frames[-1][0] >= 0 and not _IS_HEAD.match(text, at):
                values, at = _values(text, at)
                out.append((outer, around, values))
            continue
        name = m["name"] or m["quoted"] or m["attribute"] or m["flag"] or m["tag"]
        weight = max(sensitivity(name), NESTED * around)
        if m["tag"]:
            out.append((name, weight, [[(*m.span("body"), None)]]))
            at = m.start("body")
        elif indent is not None and m["op"] == ":" and (block := _BLOCK.match(text, at)):
            out.append((name, weight, [_block(text, block.end(), indent)]))
            at = block.end()
        elif indent is not None and m["op"] == ":" and (end := _END.match(text, at)):
            frames.append((indent, name, weight))
            at = max(at, end.end() - 1)
        else:
            opens = (at, name, weight)
            values, at = _values(text, at)
            out.append((name, weight, values))
    return out


def literals(text: str, min_score: float) -> list[tuple[int, int, float, str]]:
    """(start, end, score, name) of the pieces of literals that flow to a sensitive name."""
    pairs = [(name.lstrip("-.").rpartition(".")[2] or name, weight, values) for name, weight, values in lex(text)]
    weights: dict[str, tuple[float, str]] = {}
    for name, weight, _ in pairs:
        weights[name] = max(weights.get(name, (0.0, "")), (weight, name))
    # a bare piece that is the name of a pair refers to it: what it is assigned to weighs on it
    sources: dict[str, set[str]] = {}
    parts: list[tuple[str, float, list[Piece]]] = []
    for name, weight, values in pairs:
        for pieces in values:
            kept = []
            for a, b, word in pieces:
                known = (word or "").lstrip("$").rpartition(".")[2]
                if known in weights:
                    sources.setdefault(name, set()).add(known)
                elif b > a:
                    kept.append((a, b, word))
            if kept:
                parts.append((name, weight, kept))
    heap = [(-weight, sink, name) for name, (weight, sink) in weights.items() if weight > 0]
    heapq.heapify(heap)
    while heap:
        weight, sink, name = heapq.heappop(heap)
        for source in sources.pop(name, ()):
            if weights[source][0] < -weight:
                weights[source] = (-weight, sink)
                heapq.heappush(heap, (weight, sink, source))
    best: dict[tuple[int, int], tuple[float, str]] = {}
    for name, own, pieces in parts:
        weight, sink = max(weights[name], (own, name))
        if weight >= min_score and (score := weight * randomness("".join(text[a:b] for a, b, _ in pieces))) >= min_score:
            for a, b, _ in pieces:
                best[a, b] = max(best.get((a, b), (0.0, "")), (score, sink))
    return sorted((a, b, score, sink) for (a, b), (score, sink) in best.items())


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base patterns, leftmost non-overlapping per kind, sorted."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def scan(text: str, min_score: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans: the base ones and those literals that are no span of a base kind yet."""
    base = base_spans(text)
    if not _HINT.search(_JOINTS.sub("", text)):
        return base, base
    taken = {(a, b) for a, _, b in base}
    return base, sorted([*base, *((a, 3, b) for a, b, _, _ in literals(text, min_score) if (a, b) not in taken)])


def redact(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping or touching spans replaced by the mark."""
    out, at, end = [], 0, -1
    for a, _, b in spans:
        if a > end:
            if end >= 0:
                out.append(mark)
                at = end
            out.append(text[at:a])
            end = b
        end = max(end, b)
    return "".join([*out, mark, text[end:]]) if spans else text


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_score: float = 0.5) -> DataFrame:
    """One row per document: id_col, n_assign, n_access, n_hex, base_sha256, spans, n_literal.

    base_sha256 is of the base spans as ``kind:start:end`` joined by commas, spans are all spans so joined.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, found = scan(text.as_py() or "", min_score)
                n = Counter(k for _, k, _ in base)
                rows.append((n[0], n[1], n[2], hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(found), len(found) - len(base)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], names=names)

    names = [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_literal"]
    source = docs.select(quoted(id_col), quoted(text_col))
    schema = T.StructType([source.schema[0], *T._parse_datatype_string("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_literal long")])
    return map_arrow(source, run, schema)


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", min_score: float = 0.5) -> DataFrame:
    """All rows and columns, with each secret in text_col replaced and length_col, if any, set to the new length.

    Null texts stay null, and their length with them.
    """
    at = docs.columns.index(text_col)
    length = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            texts = [None if (t := x.as_py()) is None else redact(t, scan(t, min_score)[1]) for x in batch.column(at)]
            columns[at] = pa.array(texts, pa.string())
            if length is not None:
                old = batch.column(length)
                columns[length] = pa.array([n if t is None else len(t) for t, n in zip(texts, old.to_pylist(), strict=True)], old.type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return map_arrow(docs, run, docs.schema)
