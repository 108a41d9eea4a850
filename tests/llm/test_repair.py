"""Repaired conversations against a plain search over all edits."""

import hashlib
import re
import zlib
from collections import defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelmill.llm import lightest_repair
from labelmill.llm.lightest_repair import BLANK, DUPLICATE, SOUND, TRUNC, block_items, joined, letter, lightest
from labelmill.llm.queries import QUERIES

ROLE = {"u": "user", "a": "assistant"}


def plain_cheapest(rows):
    """(cost, audit, repaired) of rows (role, text, fault), row by row over all role strings so far."""
    step = {"": "su", "s": "u", "u": "a", "a": "u"}

    def widen(states):
        # at most two insertions in a row can be part of a cheapest repair
        for _ in range(2):
            for state, (cost, audit, out) in list(states.items()):
                for r in "ua":
                    if r in step[state]:
                        new = (cost + 2, audit + "I", out + [(ROLE[r], "")])
                        if r not in states or new[:2] < states[r][:2]:
                            states[r] = new
        return states

    states = widen({"": (0, "", [])})
    for role, text, fault in rows:
        after = {}
        for state, (cost, audit, out) in states.items():
            options = [(state, 3, "D", [])]
            if fault not in ("blank", "duplicate"):
                t = fault == "truncated"
                if role[:1] and role[:1] in step[state]:
                    options.append((role[:1], t, "K", [(role, text)]))
                options += [(r, 2 + t, "R", [(ROLE[r], text)]) for r in "ua" if r in step[state]]
            for nxt, more, letter_, new in options:
                entry = (cost + more, audit + letter_, out + new)
                if nxt not in after or entry[:2] < after[nxt][:2]:
                    after[nxt] = entry
        states = widen(after)
    return min((states[s] for s in ("", "a") if s in states), key=lambda e: e[:2])


def plain_row(conv_id, rows):
    """The result of rows (turn, role, text) without nulls in role and text."""
    digest = lambda r, t: hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[1], r[2])))
    seen, marked = set(), []
    for _, role, text in rows:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        marked.append((role, text, fault))
    cost, audit, out = plain_cheapest(marked)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    n = lambda f: sum(m[2] == f for m in marked)
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv_id, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, sha)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        h = zlib.crc32(key.encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_table(original, damaged):
    rows = defaultdict(list)
    for conv, *row in damaged:
        rows[conv].append(row)
    return {conv: plain_row(conv, rows[conv]) for conv in {r[0] for r in original}}


def results(df):
    names = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()
    rows = [tuple(r) for r in df.select(*names).collect()]
    assert len({r[0] for r in rows}) == len(rows)
    return {r[0]: r for r in rows}


FAULTS = {"": SOUND, "truncated": TRUNC, "blank": BLANK, "duplicate": DUPLICATE}
rows_of = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.sampled_from(list(FAULTS))), max_size=14)
to_codes = lambda rows: "".join(letter(r[0] if r[0] in "sua" else "o", FAULTS[f]) for r, f in rows)


@settings(max_examples=400, deadline=None)
@given(rows_of)
def test_the_agenda_finds_the_cheapest_edits(rows):
    assert lightest(to_codes(rows)) == plain_cheapest([(r, "x", f) for r, f in rows])[:2]


@settings(max_examples=200, deadline=None)
@given(rows_of, st.integers(1, 4))
def test_blocks_give_the_same(rows, size):
    codes = to_codes(rows)
    blocks = [codes[i : i + size] for i in range(0, len(codes), size)]
    assert joined([block_items(block) for block in blocks]) == lightest(codes)


def test_all_short_audits():
    """Every audit of up to three rows, spelled out."""
    kinds = [(r, f) for r in ("system", "user", "assistant", "tool") for f in FAULTS]
    ok = re.compile("(s?(ua)+)?")
    for n in (0, 1, 2):
        for rows in product(kinds, repeat=n):
            found = []
            for choice in product(*[["K", "Ru", "Ra", "D"]] * n):
                for gaps in product(["", "u", "a", "ua", "au"], repeat=n + 1):
                    roles, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
                    for (role, fault), c, g in zip(rows, choice, gaps[1:]):
                        if fault in ("blank", "duplicate") and c != "D":
                            break
                        roles += "" if c == "D" else role[0] if c == "K" else c[1]
                        cost += {"K": 0, "R": 2, "D": 3}[c[0]] + (fault == "truncated" and c != "D") + 2 * len(g)
                        roles, audit = roles + g, audit + c[0] + "I" * len(g)
                    else:
                        if ok.fullmatch(roles):
                            found.append((cost, audit))
            assert lightest(to_codes(rows)) == min(found)


def test_the_query(spark, sf_dir):
    original = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(QUERIES["op13_lightest_repair"](spark, sf_dir)) == plain_table(original, plain_damage(original))


ODD = [
    (None, None, None, None), (None, 1, "user", "Hi."), (1, None, "user", "a."), (1, 1, "assistant", "b."), (1, 1, "assistant", "c."),
    (2, 5, "", "x."), (2, 9, "tool", "y"), (2, 9, "tool", "y"), (2, 9, "tool", "y"), (3, 0, "system", "\t\r\n \x0b\x0c"), (3, 1, "user", " \x85"),
    (4, 0, "user", "same."), (4, 0, "user", "same."), (4, -7, "user", "same."), (5, 2, "user", "ends.  "), (5, 3, "assistant", "w " * 100_000 + "!"),
    (6, 0, "user", "é😀."), (6, 1, "assistant", "ok?\n\n"), (7, 1, "users", "u."), (7, 2, "agent", "a."),
]


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "x", "y") for r in ODD], "conv_id long, turn long, role string, text string, audit string, conv string").repartition(3)
    rows = [(c, t, *(" " if x is None else x for x in rest)) for c, t, *rest in ODD]
    assert results(lightest_repair.repair(df)) == plain_table(rows, rows)
    known = spark.createDataFrame([(1,), (77,)], "conv_id long")
    assert results(lightest_repair.repair(df.filter("conv_id = 1"), known))[77] == plain_row(77, [])
    empty = df.limit(0)
    assert lightest_repair.repair(empty).count() == 0
    assert lightest_repair.repaired_turns(empty).count() == 0


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, 1, 2) for t in (None, *range(40)) for r, x in (("user", "a. b! c? d"), (None, None))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, lightest_repair.damaged(df).collect()), key=key) == sorted(plain_damage(rows), key=key)


@pytest.mark.parametrize("block", [3, 1024])
def test_a_conversation_with_most_rows(spark, block):
    """Its rows lie in many partitions and blocks; copies of a row lie far apart."""
    words = ["one.", "two", "three!", "", "four.", "five?"]
    rows = [(1, i // 2, ["user", "assistant", "tool", "system"][i * i % 4], f"{words[i % 6]}" if i % 5 == 0 else f"{i} {words[i % 6]}") for i in range(900)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(2, 40) for t in range(4)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    assert results(lightest_repair.repair(df, block=block)) == plain_table(rows, rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello."), (1, 1, "user", "Again"), (2, 0, "assistant", "Well."), (3, 0, "user", " ")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = [tuple(r) for r in lightest_repair.repaired_turns(df).orderBy("conv_id", "place").collect()]
    assert found == [
        (1, 0, "K", "user", "Hello."), (1, 1, "R", "assistant", "Again"),
        (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Well."),
    ]
