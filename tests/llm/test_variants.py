"""Chat formatting, spelling variants and vector codes against brute force, with their edge cases."""

from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stockcast.llm import chat, spelling, vector_codes

from .test_llm import VECTORS, docs

ROWS = "conv_id long, turn long, role string, text string"
ODD = "o`d.d"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# --- chat formatting


def hostile_text(rng):
    parts = [*chat.CONTROLS, "\\", "\\\\", "<", "|", "end|>", "[", "INST]", "a", "é", "中", "\n", " ", "<|<|end|>", "\\<|end|>", ""]
    return "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))


def test_rows_come_back_from_the_format(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, "<|end|>"]), rng.choice([None, hostile_text(rng), hostile_text(rng)])) for c in [*range(60), None] for t in [None, *range(rng.randrange(1, 6))]]
    rows += [(5, 1, "user", "twice")] * 2 + [(900, 0, "user", "long " * 200_000), (900, 1, "assistant", "<|end|>" * 50_000)]
    df = spark.createDataFrame(rows, ROWS).withColumns({n: F.lit(n) for n in ("conv", "formatted", "loss", "_k", "turns", "layout", "fingerprint", ODD)})
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    made = chat.format_rows(df)
    plain = {r["conv"]: r for r in made.collect()}
    read = {r["conv"]: r for r in chat.read_back(made).collect()}
    assert set(read) == set(by)
    for c, r in read.items():
        want = [(role, text) for _, _, role, text in sorted(by[c])]
        assert [(t["role"], t["text"]) for t in r["turns"]] == want
        assert list(r["learnt"]) == [text for role, text in want if role == "assistant"]
        whole = plain[c]["formatted"]
        assert whole.count("<|start|>") == whole.count("<|end|>") == len(want) and r["formatted_chars"] == len(whole)
        assert not any(m in whole for m in chat.CONTROLS[3:])
    assert chat.format_rows(df.filter("false")).count() == 0


def test_layouts_by_fingerprint(spark):
    q, a = {"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}
    cases = [
        ({"messages": [q, a], "id": 3, "meta": {"x": [1]}}, "messages", [("user", "q"), ("assistant", "a")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "p"}, {"type": "text", "text": "q"}]}]}, "message parts", [("user", "pq")]),
        ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}, "shared", [("user", "q"), ("assistant", "a")]),
        ({"system": "s", "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, "shared", [("system", "s"), ("user", "q"), ("assistant", "")]),
        ({"instruction": "i", "input": "", "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"instruction": "i", "input": "x", "output": "o"}, "instruction", [("user", "i\n\nx"), ("assistant", "o")]),
        ({"instruction": "i", "input": None, "output": "o"}, "instruction", [("user", "i"), ("assistant", "o")]),
        ({"prompt": "p", "completion": "c"}, "prompt", [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "prompt": "p", "response": "r"}, "response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        ({"context": "c", "question": "q", "answer": "a"}, "question", [("system", "c"), ("user", "q"), ("assistant", "a")]),
        ({"history": [{"user": "1", "assistant": "2"}], "prompt": "p", "response": "r"}, "history", [("user", "1"), ("assistant", "2"), ("user", "p"), ("assistant", "r")]),
        ({"chosen": [q, a], "rejected": [q, q]}, "chosen", [("user", "q"), ("assistant", "a")]),
        ({"data": {"messages": [q]}, "we`ird. name": 1}, "nested messages", [("user", "q")]),
        ({"prompt": "p"}, None, None),
        ({"messages": []}, None, None),
        ([q], None, None),
        ("text", None, None),
        (None, None, None),
    ]
    rows = [(k, json.dumps(c)) for k, (c, _, _) in enumerate(cases)] + [(100, "{broken"), (101, None), (102, "")]
    df = spark.createDataFrame(rows, "id long, j string").toDF("id", ODD)
    found = {r["id"]: r for r in chat.json_records(df, ODD, ("id",)).collect()}
    assert len(found) == len(rows) and all(found[k]["layout"] is None and found[k]["turns"] is None for k in (100, 101, 102))
    for k, (_, name, turns) in enumerate(cases):
        assert found[k]["layout"] == name and (found[k]["turns"] and [tuple(t) for t in found[k]["turns"]]) == turns, cases[k]
    assert found[0]["fingerprint"] == sha("messages[].content\nmessages[].role") != found[1]["fingerprint"]
    formatted = {r["conv"]: r for r in chat.read_back(chat.format_json(df, ODD, "id")).collect()}
    assert set(formatted) == {k for k, c in enumerate(cases) if c[2]} and all([tuple(t) for t in formatted[k]["turns"]] == cases[k][2] for k in formatted)


def test_nested_columns_have_the_layouts_of_json(spark):
    schema = "id long, messages array<struct<role: string, content: string>>, instruction string, output string, input string, data struct<messages: array<struct<role: string, content: string>>>"
    rows = [(1, [("human", "q"), ("assistant", None)], None, None, None, None), (2, None, "i", "o", None, None), (3, None, "i", "o", "x", None), (4, None, None, None, None, ([("user", "n")],)), (5, None, None, "o", None, None), (6, [], None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    found = {r["id"]: r for r in chat.columns_records(df, tuple(df.columns[1:]), ("id",)).collect()}
    assert [found[k]["layout"] for k in range(1, 7)] == ["messages", "instruction", "instruction", "nested messages", None, None]
    assert [tuple(t) for t in found[1]["turns"]] == [("user", "q"), ("assistant", "")] and [tuple(t) for t in found[3]["turns"]] == [("user", "i\n\nx"), ("assistant", "o")]
    assert [tuple(t) for t in found[4]["turns"]] == [("user", "n")]
    same = {r["id"]: r["fingerprint"] for r in chat.json_records(df.select("id", F.to_json(F.struct(*df.columns[1:])).alias("j")), "j", ("id",)).collect()}
    assert same == {k: r["fingerprint"] for k, r in found.items()}


def test_templates_that_can_not_be_read_back_are_refused():
    for marks in ({"start": "<"}, {"start": "a\\b"}, {"end": "<|start|>"}, {"start": "[x<", "end": "<y]"}):
        with pytest.raises(ValueError):
            chat.Template(**marks)


def test_formatting_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], ROWS)
    plan = chat.read_back(chat.format_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


# --- spelling variants


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_forms(rows):
    n = Counter()
    for name, text in rows:
        for run in spelling.RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            n[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def forms_of(df):
    return [tuple(r) for r in spelling.spelling_forms(df).select("word", "form", "root", "n", "n_near", "form_n").collect()]


def test_forms_equal_brute_force(spark):
    rng = random.Random(11)
    letters = ["ab", "abÿé×", "abcdefgh"]
    words = ["".join(rng.choice(letters[k % 3]) for _ in range(rng.randrange(3, 8))) for k in range(250)] + ["aaaaa", "aaaaaa", "aaaaaaa", "ÀAAAAA", "àaaaaa", "x" * 300, "x" * 299, "y" + "x" * 299]
    weights = [1 / (1 + k % 40) for k in range(len(words))]
    texts = [" ".join(w.upper() if rng.random() < 0.1 else w for w in rng.choices(words, weights, k=rng.randrange(1, 60))) for _ in range(150)] + [None, "", "  \n", "ǅword word1word_word"]
    df = docs(spark, texts)
    df = df.union(df.filter("doc_id < 20")).union(df.filter("doc_id < 9").withColumn("doc_id", F.lit(None).cast("long"))).withColumns({c: F.lit(1) for c in ("word", "n", "id", "key", ODD)})
    want = brute_forms([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()])
    found = forms_of(df)
    assert len(found) == len(want) > 100 and set(found) == want and any(f[1] and f[2] != f[1] for f in want)
    assert forms_of(df.filter("false")) == []


def test_strings_decide_when_hashes_collide(spark, monkeypatch):
    whole = spelling.deletion_keys
    rows = [(k, w) for k in range(3) for w in ["alpha beta alphas gamma gammb", "alpha alpha betas betat alphb xalpha alpma"]]
    df = docs(spark, [t for _, t in rows]).repartition(1)
    want = brute_forms([(r["doc_id"], r["text"]) for r in df.collect()])

    def colliding(words):
        keys, row, place = whole(words)
        return (keys & 1) | 4, row, place

    monkeypatch.setattr(spelling, "deletion_keys", colliding)
    assert set(forms_of(df)) == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="abÿ", min_size=1, max_size=8), min_size=1, max_size=6))
def test_keys_are_hashes_of_what_is_left(words):
    keys, row, place = spelling.deletion_keys(words)
    by = {}
    for k, r, p in zip(keys.tolist(), row.tolist(), place.tolist(), strict=True):
        w = words[r]
        left = (w, None) if p < 0 else (w[:p] + w[p + 1 :], p if k & 1 else None)
        by.setdefault(left, set()).add(k)
    assert all(len(v) == 1 for v in by.values()) and len(set.union(*by.values())) == len(by)
    assert len(keys) == sum(2 * len(w) + 1 - sum(a == b for a, b in zip(w, w[1:], strict=False)) for w in words)


def test_a_long_word_takes_linear_time():
    import time

    began = time.process_time()
    keys, _, _ = spelling.deletion_keys(["ab" * 500_000])
    assert len(keys) == 2_000_001 and time.process_time() - began < 5


# --- vector codes


def brute_codes(rows, rounds=6):
    """rows: (id, integers, label) in order of id; plain integer arithmetic."""
    w = len(rows[0][1]) // 8
    parts = [[r[1][p * w : (p + 1) * w] for p in range(8)] for r in rows]
    books = [[parts[k][p] for k in range(min(16, len(rows)))] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    pick = lambda part, book: min(range(len(book)), key=lambda e: (far(part, book[e]), e))
    for _ in range(rounds):
        for p in range(8):
            chosen = [pick(x[p], books[p]) for x in parts]
            for e in range(len(books[p])):
                if own := [x[p] for x, c in zip(parts, chosen, strict=True) if c == e]:
                    books[p][e] = [sum(v) // len(own) for v in zip(*own, strict=True)]
    codes = [[pick(x[p], books[p]) for p in range(8)] for x in parts]
    errors = [sum(far(x[p], books[p][c[p]]) for p in range(8)) for x, c in zip(parts, codes, strict=True)]
    told = sha(",".join(str(v) for b in books for e in b for v in e))
    total = Counter()
    for r, e in zip(rows, errors, strict=True):
        total[r[2]] += e
    return [(r[0], "".join(f"{k:02x}" for k in c), e, total[r[2]], told) for r, c, e in zip(rows, codes, errors, strict=True)]


def codes_of(df):
    return sorted((tuple(r) for r in vector_codes.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=lambda r: (r[0] is None, r[0], r[1]))


def test_codes_equal_plain_integers(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 16)).astype(np.float32)
    x[20:60] = x[:40]
    x[60:70] = np.round(x[60:70])
    ids = rng.permutation(150) - 20
    rows = [(int(i), v.tolist(), None if i % 7 == 0 else int(i) % 3) for i, v in zip(ids, x, strict=True)]
    bad = [(900, None, 1), (-900, [float("nan")] * 16, 1), (-901, [1.0, None] * 8, 1), (-902, [float("inf")] + [0.0] * 15, 1)]
    df = spark.createDataFrame(rows + bad, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("code", "error", "d", "id", "c0", ODD)})
    want = brute_codes([(i, [int(np.floor(4096 * float(c))) for c in v], label) for i, v, label in sorted(rows, key=lambda r: r[0])])
    assert codes_of(df) == want
    assert codes_of(df.filter("false")) == [] and codes_of(df.filter("vec_id = 900")) == []
    few = codes_of(df.filter("vec_id between 0 and 4"))
    assert len(few) == 5 and all(e == 0 for _, _, e, _, _ in few)


def test_other_lengths_ties_repeats_and_null_ids(spark):
    rows = [(1, [1.0] * 10, 0), (1, [1.0] * 10, 0), (None, [2.0] * 10, None), (2, [], 0), (3, [1e30] * 8, None), (4, [-1e30] * 8, None), (5, [0.5, 0.25, 0.125], 0)]
    df = spark.createDataFrame(rows, VECTORS)
    found = codes_of(df)
    assert [r[0] for r in found] == [1, 1, 2, 3, 4, 5, None] and all(r[2] == 0 and r[3] == 0 for r in found)
    assert len({r[4] for r in found}) == 4 and found[0][1] == found[1][1] == "00" * 8
    books = vector_codes.fit(df.filter("vec_id = 5"))
    back = vector_codes.decode(vector_codes.encode(df.filter("vec_id = 5"), books), books, 3).first()
    assert back["decoded"] == [0.5, 0.25, 0.125]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32), st.integers(1, 12), st.sampled_from([1, 3, 4096, 2**24, 2**26]))
def test_nearest_is_exact(seed, w, size):
    rng = np.random.default_rng(seed)
    entries = rng.integers(-size, size + 1, (16, w)) + rng.integers(-size, size + 1)
    x = np.concatenate([rng.integers(-size, size + 1, (30, w)), (entries[:8] + entries[8:]) // 2, entries, entries + 1])
    want = ((x[:, None, :].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
    assert vector_codes.nearest(x, entries).tolist() == [min(range(16), key=lambda e: (d[e], e)) for d in want.tolist()]


def test_integers_floor_down():
    found = list(vector_codes.integers(pa.array([[-0.0001, 0.5, 1e-9, -1e-9, 0, 0, 0, 0]], pa.list_(pa.float32()))))
    assert found[0][0] == 8 and found[0][2].tolist() == [[-1, 2048, 0, -1, 0, 0, 0, 0]]
