r"""Chat formatting by schema fingerprints, in DataFrame functions alone.

Records come in many layouts: prompt and completion, instruction with or without input, lists of messages, rows of
one turn each. A record's nested field paths (``messages[].role``), without those that are null and those that no layout
names, are sorted and hashed: the fingerprint. Each layout is a declaration, required and optional paths and where turns, roles and
texts stand, so it has a fingerprint for every set of its optional paths, and a record's fingerprint selects the layout that
makes its canonical turns (role, text). A record whose fingerprint no layout has keeps a row, with null for layout and turns.

Paths come from the schema and the nulls of typed columns (``columns_records``), or from the schema of each JSON text
(``json_records``), which may differ from row to row; no value is looked at more closely than that.

Turns are formatted by a Template: a start mark, the role, a middle mark, the text and an end mark. A backslash in a role or text
is doubled, and one is put after the first character of whatever the template lists as a control string, its own marks and
those of other templates; so no text can end a turn or forge one, and ``unescaped`` gives back every text. The loss mask is a list
of spans in UTF-8 bytes of the formatted text, one for each turn of a role that is learnt, its text and no mark; ``read_back``
finds turns and texts under the mask again.

A conversation of rows is one cell of the result, and so is put together in one task: rows are dealt by conversation,
places of spans are running sums over its sorted rows, and reading back is linear in its length.

Edge cases: a null text is an empty one, and so is a null role of a row of one turn; a turn of another layout without a text is an
empty text, one without a role has an empty role; rows of a conversation stand by turn (nulls first), then role, then text, so
repeated rows and ties stay, in a defined order; a null id is a conversation; JSON that is null, broken or too large for a variant
(128 MiB) has no layout; an empty table gives an empty result; other columns may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import quoted

TURNS = "array<struct<role: string, text: string>>"
#: Names of roles in common layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "chatgpt": "assistant", "model": "assistant", "prompter": "user"}
#: Control strings of common templates, which texts must not show as they are.
CONTROLS = ("<|start|>", "<|message|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>")


@dataclass(frozen=True)
class Said:
    """A turn from fields of the record: role is fixed, or a path if it begins with a dollar sign; the texts at paths are joined by two newlines."""

    role: str
    texts: tuple[str, ...]


@dataclass(frozen=True)
class Listed:
    """Turns from a list: paths of role and text in an element; parts is the path of a list of text parts in place of text."""

    items: str
    role: str
    text: str
    parts: str | None = None


@dataclass(frozen=True)
class Paired:
    """Turns from a list of pairs: each element has a list of two texts or the fields named."""

    items: str
    first: str
    second: str


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record stand. Paths that may be null or absent are optional; roles are renamed by renamed."""

    name: str
    required: tuple[str, ...]
    turns: tuple[Said | Listed | Paired, ...]
    optional: tuple[str, ...] = ()
    renamed: bool = True

    def fingerprints(self) -> list[Column]:
        """One for each set of optional paths."""
        some = (s for n in range(len(self.optional) + 1) for s in combinations(self.optional, n))
        return [_hash(F.lit("\n".join(sorted({*self.required, *s})))) for s in some]


#: Rows of one turn each.
TURN_ROWS = (Layout("turn", (), (Said("$role", ("text",)),), ("role", "text"), renamed=False),)
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), (Listed("messages", "role", "content"),)),
    Layout("message parts", ("messages[].role", "messages[].content[].text"), (Listed("messages", "role", "content", parts="text"),), ("messages[].content[].type",)),
    Layout("shared", ("conversations[].from", "conversations[].value"), (Said("system", ("system",)), Listed("conversations", "from", "value")), ("system",)),
    Layout("instruction", ("instruction", "output"), (Said("system", ("system",)), Said("user", ("instruction", "input")), Said("assistant", ("output",))), ("input", "system")),
    Layout("prompt", ("prompt", "completion"), (Said("user", ("prompt",)), Said("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), (Said("system", ("system",)), Said("user", ("prompt",)), Said("assistant", ("response",))), ("system",)),
    Layout("question", ("question", "answer"), (Said("system", ("context",)), Said("user", ("question",)), Said("assistant", ("answer",))), ("context",)),
    Layout("history", ("history[].user", "history[].assistant", "prompt"), (Paired("history", "user", "assistant"), Said("user", ("prompt",)), Said("assistant", ("response",))), ("response",)),
    Layout("chosen", ("chosen[].role", "chosen[].content"), (Listed("chosen", "role", "content"),), ("rejected[].role", "rejected[].content")),
    Layout("nested messages", ("data.messages[].role", "data.messages[].content"), (Listed("data.messages", "role", "content"),)),
)


def _hash(paths: Column) -> Column:
    return F.sha2(paths, 256)


def known_paths(layouts: tuple[Layout, ...]) -> list[str]:
    return sorted({p for one in layouts for p in (*one.required, *one.optional)})


class _Columns:
    """Records whose fields are columns."""

    def __init__(self, df: DataFrame, layouts: tuple[Layout, ...]):
        found = {p: c for f in df.schema for p, c in self._walk(f.name, F.col(quoted(f.name)), f.dataType)}
        self.paths = F.filter(F.array(*(F.when(F.coalesce(found[p], F.lit(False)), F.lit(p)) for p in known_paths(layouts) if p in found), F.lit(None).cast("string")), lambda p: p.isNotNull())
        self.layouts = tuple(one for one in layouts if all(p in found for p in one.required))
        self.found = found

    def _walk(self, path: str, value: Column, kind: T.DataType) -> list[tuple[str, Column]]:
        """Each path of a leaf with whether any value is there."""
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in self._walk(f"{path}.{f.name}", value.getField(f.name), f.dataType)]
        if isinstance(kind, T.ArrayType):
            inner = self._walk(f"{path}[]", value, kind.elementType) if not isinstance(kind.elementType, (T.StructType, T.ArrayType)) else None
            if inner is not None:
                return [(f"{path}[]", F.exists(value, lambda x: x.isNotNull()))]
            names = self._walk("", F.lit(None), kind.elementType)
            return [(f"{path}[]{n}", self._any(value, kind.elementType, k)) for k, (n, _) in enumerate(names)]
        return [(path, value.isNotNull())]

    def _any(self, values: Column, kind: T.DataType, k: int) -> Column:
        return F.exists(values, lambda x: self._walk("", x, kind)[k][1])

    def text(self, path: str) -> Column | None:
        return F.col(".".join(map(quoted, path.split(".")))).cast("string") if path in self.found else None

    def items(self, path: str) -> Column:
        return F.col(".".join(map(quoted, path.split("."))))

    def field(self, item: Column, name: str) -> Column:
        return item.getField(name).cast("string")

    def list_in(self, item: Column, name: str) -> Column:
        return item.getField(name)


class _Json:
    """Records that are variants in a column."""

    def __init__(self, column: str, layouts: tuple[Layout, ...]):
        self.column = column
        self.paths = F.array_intersect(variant_paths(F.col(column)), F.array(*map(F.lit, known_paths(layouts))))
        self.layouts = layouts

    def text(self, path: str) -> Column:
        return F.try_variant_get(F.col(self.column), f"$.{path}", "string")

    def items(self, path: str) -> Column:
        return F.try_variant_get(F.col(self.column), f"$.{path}", "array<variant>")

    def field(self, item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "string")

    def list_in(self, item: Column, name: str) -> Column:
        return F.try_variant_get(item, f"$.{name}", "array<variant>")


def variant_paths(value: Column) -> Column:
    """The paths of all leaves that aren't null, each once: the schema of the value, read by its brackets."""
    tokens = F.regexp_extract_all(F.schema_of_variant(value), F.lit(r"((?:`(?:[^`]|``)*`|[A-Za-z0-9_]+): |OBJECT<|ARRAY<|>|[A-Z]+(?:\([0-9,]+\))?)"))
    start = F.struct(F.array().cast("array<string>").alias("open"), F.lit("").alias("at"), F.array().cast("array<string>").alias("paths"))

    def step(s: Column, token: Column) -> Column:
        opens, at, paths = s["open"], s["at"], s["paths"]
        outer = F.coalesce(F.try_element_at(opens, F.lit(-1)), F.lit(""))
        name = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, ": $", ""), "^`|`$", ""), "``", "`")
        joint = F.when(outer == "", name).otherwise(F.concat(outer, F.lit("."), name))
        return (
            F.when(token.endswith(": "), F.struct(opens.alias("open"), joint.alias("at"), paths.alias("paths")))
            .when(token == "OBJECT<", F.struct(F.concat(opens, F.array(at)).alias("open"), at.alias("at"), paths.alias("paths")))
            .when(token == "ARRAY<", F.struct(F.concat(opens, F.array(F.concat(at, F.lit("[]")))).alias("open"), F.concat(at, F.lit("[]")).alias("at"), paths.alias("paths")))
            .when(token == ">", F.struct(F.slice(opens, 1, F.greatest(F.size(opens) - 1, F.lit(0))).alias("open"), outer.alias("at"), paths.alias("paths")))
            .when(token == "VOID", s)
            .otherwise(F.struct(opens.alias("open"), at.alias("at"), F.concat(paths, F.array(at)).alias("paths")))
        )

    return F.array_distinct(F.coalesce(F.aggregate(tokens, start, step, lambda s: s["paths"]), F.array().cast("array<string>")))


def _turns_of(record: _Columns | _Json, layout: Layout) -> Column:
    def role_of(role: Column | None) -> Column:
        role = F.coalesce(role, F.lit("")) if role is not None else F.lit("")
        return reduce(lambda c, kv: c.when(F.lower(role) == kv[0], kv[1]), ROLES.items(), F.when(F.lit(False), "")).otherwise(role) if layout.renamed else role

    def turn(role: Column, text: Column) -> Column:
        return F.struct(role.alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    def listed(one: Listed) -> Callable[[Column], Column]:
        def text_of(item: Column) -> Column:
            if one.parts is None:
                return record.field(item, one.text)
            return F.array_join(F.transform(record.list_in(item, one.text), lambda x: F.coalesce(record.field(x, one.parts), F.lit(""))), "")

        return lambda item: turn(role_of(record.field(item, one.role)), text_of(item))

    def paired(one: Paired) -> Callable[[Column], Column]:
        return lambda item: F.array(turn(F.lit("user"), record.field(item, one.first)), turn(F.lit("assistant"), record.field(item, one.second)))

    parts = []
    for one in layout.turns:
        if isinstance(one, Said):
            texts = [t for t in map(record.text, one.texts) if t is not None]
            fixed = not one.role.startswith("$")
            role = F.lit(one.role) if fixed else role_of(record.text(one.role[1:]))
            if fixed:
                text = F.concat_ws("\n\n", *(F.nullif(t, F.lit("")) for t in texts))
                there = reduce(lambda a, b: a | b, (t.isNotNull() for t in texts), F.lit(False))
                parts.append(F.when(there, F.array(turn(role, text))).otherwise(F.array().cast(TURNS)))
            else:
                parts.append(F.array(turn(role, texts[0] if texts else F.lit(None).cast("string"))))
        elif isinstance(one, Listed):
            parts.append(F.transform(record.items(one.items), listed(one)))
        else:
            parts.append(F.flatten(F.transform(record.items(one.items), paired(one))))
    return F.concat(*parts).cast(TURNS)


def _canonical(df: DataFrame, keep: list[Column], record: _Columns | _Json) -> DataFrame:
    """The columns to keep, with fingerprint, layout and turns."""
    marked = df.withColumn("_fingerprint", _hash(F.array_join(F.array_sort(record.paths), "\n")))
    name, turns = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.array().cast(TURNS))
    for layout in record.layouts:
        its = reduce(lambda a, b: a | b, (F.col("_fingerprint") == x for x in layout.fingerprints()))
        name, turns = name.when(its, F.lit(layout.name)), turns.when(its, _turns_of(record, layout))
    return marked.select(*keep, F.col("_fingerprint").alias("fingerprint"), name.alias("layout"), turns.alias("turns"))


def json_records(df: DataFrame, json_col: str, id_cols: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id_cols, fingerprint, layout, turns) of records that are JSON texts, each with a layout of its own."""
    plain = df.select(*(F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(id_cols)), F.try_parse_json(F.col(quoted(json_col))).alias("_json"))
    return _canonical(plain, [F.col(f"_k{i}").alias(c) for i, c in enumerate(id_cols)], _Json("_json", layouts))


def columns_records(df: DataFrame, fields: tuple[str, ...], id_cols: tuple[str, ...] = (), layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(id_cols, fingerprint, layout, turns) of records whose fields are columns of any nested type."""
    plain = df.select(*(F.col(quoted(c)).alias(f"_k{i}") for i, c in enumerate(id_cols)), *(F.col(quoted(c)) for c in fields))
    return _canonical(plain, [F.col(f"_k{i}").alias(c) for i, c in enumerate(id_cols)], _Columns(plain.select(*(F.col(quoted(c)) for c in fields)), layouts))


@dataclass(frozen=True)
class Template:
    """Marks of a turn, roles that are learnt, and the strings that a role or text must not show."""

    start: str = "<|start|>"
    middle: str = "<|message|>"
    end: str = "<|end|>"
    learnt: tuple[str, ...] = ("assistant",)
    controls: tuple[str, ...] = CONTROLS

    def __post_init__(self) -> None:
        marks = (self.start, self.middle, self.end)
        if any(len(c) < 2 or "\\" in c for c in (*marks, *self.controls)) or len(set(marks)) < 3:
            raise ValueError("marks differ, have two characters at least and no backslash")
        both = [(a, b) for m in marks for c in (*marks, *self.controls) for a, b in ((m, c), (c, m))]
        if any(a[-k:] == b[:k] for a, b in both for k in range(1, min(len(a), len(b)))):
            raise ValueError("no mark may end as another control string begins, or begin as one ends")

    def escaped(self, text: Column) -> Column:
        strings = sorted({self.start, self.middle, self.end, *self.controls})
        hidden = "|".join(f"{_literal(s[0])}(?={_literal(s[1:])})" for s in strings)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({hidden})", r"$1\\")

    @staticmethod
    def unescaped(text: Column) -> Column:
        return F.regexp_replace(text, r"\\(\\?)", "$1")


def _literal(s: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", s)


def format_turns(turns: DataFrame, conv: str = "conv", order: tuple[str, ...] = ("turn",), template: Template = Template()) -> DataFrame:
    """(conv, formatted, loss) of rows (conv, order, role, text): the conversation as one text, and the byte spans under the loss mask."""
    head = F.concat(F.lit(template.start), template.escaped(F.col("role")), F.lit(template.middle))
    pieces = turns.select(conv, *order, "role", "text", head.alias("_head"), template.escaped(F.col("text")).alias("_body"))
    sized = pieces.select("*", F.octet_length("_head").cast("long").alias("_h"), F.octet_length("_body").cast("long").alias("_b"))
    rows = Window.partitionBy(conv).orderBy(*order, "role", "text")
    whole = F.col("_h") + F.col("_b") + len(template.end.encode())
    placed = sized.select(conv, "role", F.row_number().over(rows).alias("_k"), F.concat("_head", "_body", F.lit(template.end)).alias("_piece"), (F.sum(whole).over(rows.rowsBetween(Window.unboundedPreceding, 0)) - whole + F.col("_h")).alias("_from"), "_b")
    span = F.when(F.col("role").isin(*template.learnt), F.struct(F.col("_from").alias("start"), (F.col("_from") + F.col("_b")).alias("end")))
    found = placed.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct("_k", "_piece", span.alias("_span")))).alias("_all"))
    spans = F.filter(F.transform("_all", lambda x: x["_span"]), lambda s: s.isNotNull())
    return found.select(conv, F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: DataFrame, conv: str = "conv", template: Template = Template()) -> DataFrame:
    """(conv, turns, learnt, formatted_chars): the turns of a formatted text, and the texts under its loss mask, in order."""
    pieces = F.split(F.col("formatted"), _literal(template.end))
    mark, middle = len(template.start) + 1, _literal(template.middle)

    def turn(piece: Column) -> Column:
        halves = F.split(piece, middle, 2)
        return F.struct(template.unescaped(F.substring(halves[0], F.lit(mark), F.length(halves[0]))).alias("role"), template.unescaped(halves[1]).alias("text"))

    under = F.transform("loss", lambda s: template.unescaped(F.substring(F.col("_bytes"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")).cast("string")))
    with_bytes = formatted.withColumn("_bytes", F.col("formatted").cast("binary"))
    return with_bytes.select(conv, F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn).alias("turns"), under.alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))


def format_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: Template = Template()) -> DataFrame:
    """(conv, formatted, loss) of rows of one turn each, which go through their fingerprints."""
    plain = rows.select(*(F.col(quoted(c)).alias(n) for c, n in ((conv_col, "conv"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))))
    record = columns_records(plain, ("role", "text"), ("conv", "turn"), TURN_ROWS)
    each = record.select("conv", "turn", F.inline("turns"))
    return format_turns(each, "conv", ("turn",), template)


def format_json(df: DataFrame, json_col: str, id_col: str, layouts: tuple[Layout, ...] = LAYOUTS, template: Template = Template()) -> DataFrame:
    """(conv, formatted, loss) of JSON records of any of the layouts, one conversation each; ids must not repeat."""
    found = json_records(df, json_col, (id_col,), layouts).filter(F.col("turns").isNotNull())
    each = found.select(F.col(quoted(id_col)).alias("conv"), F.posexplode("turns").alias("turn", "said")).select("conv", "turn", "said.*")
    return format_turns(each, "conv", ("turn",), template)
