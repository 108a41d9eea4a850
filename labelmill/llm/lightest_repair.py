"""Repair of conversations by the cheapest edits, found with an agenda of weighted deductions.

A conversation's rows are taken by turn (null ones first; ties by role, then by
a digest of role and text, so that equal rows lie together).  A row is blank,
a duplicate (its role and text occurred before), truncated (its last character
that is no space is none of ``.!?``) or sound; the first of these counts.
Edits are Keep (0), Rerole to user or assistant (2), Delete (3; the only edit
of blank and duplicate rows) and Insert of an empty user or assistant row (2);
a truncated row that stays costs 1 more.  The initials of the repaired roles
are to read ``(s?(ua)+)?``.

Deductions.  An item says that the first i rows can be repaired so that the
roles so far end in a state of that pattern, and carries (cost, audit), the
audit being the initials of the edits.  A rule takes an item and an edit of the
next row, or an item and an insertion, to another item; it adds costs and
appends to the audit.  Items wait on an agenda and are popped by cost, then
rows, then audit.  No rule lowers that key and a smaller antecedent gives a
smaller consequent (two audits of one item with equal costs are never prefixes
of each other, as insertions cost), so the first pop of an item is its lightest
derivation, and the search ends when the goal is popped (Knuth 1977).

Long conversations.  Rows are dealt out by ranges of (conversation, turn), so
a conversation of any share of the table is spread over tasks.  Each cuts its
stretches into blocks of ``BLOCK`` rows, of one byte each, and derives every
block from every state it may begin in; a second agenda of the same kind joins
the blocks' items, which stand for whole stretches.  Texts are shuffled once, to
be put out in order: there a conversation passes through one task as a stream
of batches, as its digest is defined over all of it in sequence, and only the
audit (a byte for each edit) is held in memory.  An audit is one string, so a
conversation is bound to some ten million rows.

Null roles and texts are one space, hence blank or to be reroled; a role that
begins with none of s, u, a cannot be kept.  Null conversation ids are one
conversation.  Repeated rows are duplicates.  A conversation without rows has
zeros, an empty audit and the digest of the empty string; an empty table gives
an empty table.  Only the four named columns are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from labelmill.llm.common import keep, prepare

# fixed values: the edits' costs and the pattern of the roles
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: State (the last role, ^ for none): the roles that may follow.
FOLLOWS = {"^": "su", "s": "u", "u": "a", "a": "u"}
ENDS = "^a"
LEGAL = {"su", "ua", "au"}

#: A row as one letter: four kinds of role times four faults.
INITIALS = "suao"
SOUND, TRUNC, BLANK, DUPLICATE = range(4)
#: Rows of a block.
BLOCK = 1024

_SPACE = "\\x20\\x09-\\x0D"


def letter(initial: str, fault: int) -> str:
    return chr(97 + 4 * INITIALS.index(initial) + fault)


def role_and_fault(code: str) -> tuple[str, int]:
    kind, fault = divmod(ord(code) - 97, 4)
    return INITIALS[kind], fault


@lru_cache(maxsize=None)
def row_edits(code: str, state: str) -> tuple[tuple[int, str, str], ...]:
    """(cost, edit, next state) of a row's edits."""
    initial, fault = role_and_fault(code)
    edits = [(DELETE, "D", state)]
    if fault in (SOUND, TRUNC):
        more = TRUNCATED if fault == TRUNC else 0
        edits += [(KEEP + more, "K", initial)] if initial in FOLLOWS[state] else []
        edits += [(REROLE + more, "R", role) for role in ROLES if role in FOLLOWS[state]]
    return tuple(edits)


#: The state of the goal item.
GOAL = "$"


def _derive(codes: str, begin: str, goals: str) -> dict[str, tuple[int, str]]:
    """The lightest (cost, audit) by which ``codes`` lead from ``begin`` to each state of ``goals``.

    The goal ``$`` follows from every state in which a conversation may end.
    """
    ends: dict[str, tuple[int, str]] = {}
    done = set()
    agenda = [(0, 0, "", begin)]
    while agenda:
        cost, i, audit, state = heapq.heappop(agenda)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i >= len(codes) and state in goals:
            ends[state] = (cost, audit)
            if len(ends) == len(goals):
                break
        if state == GOAL:
            continue
        for role in ROLES:
            if role in FOLLOWS[state] and (i, role) not in done:
                heapq.heappush(agenda, (cost + INSERT, i, audit + "I", role))
        if i == len(codes):
            if state in ENDS:
                heapq.heappush(agenda, (cost, i + 1, audit, GOAL))
            continue
        for more, edit, after in row_edits(codes[i], state):
            if (i + 1, after) not in done:
                heapq.heappush(agenda, (cost + more, i + 1, audit + edit, after))
    return ends


@lru_cache(maxsize=4096)
def lightest(codes: str) -> tuple[int, str]:
    """The lightest (cost, audit) of a whole conversation: the search ends as the goal is popped."""
    return _derive(codes, "^", GOAL)[GOAL]


def block_items(codes: str) -> dict[tuple[str, str], tuple[int, str]]:
    """(begin, end): (cost, audit) of a block, from each state to each that can be reached."""
    return {(b, e): item for b in FOLLOWS for e, item in _derive(codes, b, "".join(FOLLOWS)).items()}


def joined(blocks: list[dict[tuple[str, str], tuple[int, str]]]) -> tuple[int, str]:
    """The lightest derivation of a whole conversation from the items of its blocks."""
    done = set()
    agenda = [(0, 0, "", "^")]
    while True:
        cost, at, audit, state = heapq.heappop(agenda)
        if (at, state) in done:
            continue
        done.add((at, state))
        if state == GOAL:
            return cost, audit
        if at == len(blocks):
            if state in ENDS:
                heapq.heappush(agenda, (cost, at + 1, audit, GOAL))
            continue
        for after in FOLLOWS:
            item = blocks[at].get((state, after))
            if item is not None and (at + 1, after) not in done:
                heapq.heappush(agenda, (cost + item[0], at + 1, audit + item[1], after))


def counted(codes: str, before: str = "") -> tuple[int, int, int, int]:
    """Blank, duplicate and truncated rows and illegal neighbours, the row before the first one included."""
    rows = [role_and_fault(c) for c in codes]
    initials = before + "".join(r for r, _ in rows)
    faults = [f for _, f in rows]
    illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
    return faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNC), illegal


def row_code(role: Column, text: Column) -> Column:
    """The letter of a row, duplicates left aside."""
    kind = F.when(role.startswith("s"), 0).when(role.startswith("u"), 1).when(role.startswith("a"), 2).otherwise(3)
    sound = text.rlike(f"[.!?][{_SPACE}]*\\z")
    fault = F.when(~text.rlike(f"[^{_SPACE}]"), BLANK).when(~sound, TRUNC).otherwise(SOUND)
    return F.char(F.lit(97) + 4 * kind + fault)


_PIECES = "part long, block long, inner boolean, codes string, first_turn long, last_turn long, n_turns long"


def _pieces(batches: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of a partition's conversations, the rows of which come in order.

    ``inner`` is set where the block is all of a conversation for sure; the
    first and last conversation of a partition may go on in another one.
    """
    part = TaskContext.get().partitionId()
    out: list[tuple] = []
    codes: list[str] = []
    conv, begun, block, first_of_all = None, False, 0, True
    turns = [None, None, 0]
    last: tuple = ()

    def close(final: bool) -> None:
        inner = final and block == 0 and not first_of_all
        out.append((conv, part, block, inner, "".join(codes), *turns))
        codes.clear()
        turns[:] = [None, None, 0]

    def made() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns))):
            conv_id, _, turn, role, sha, code, first = row
            if begun and conv_id != conv:
                close(True)
                block, first_of_all = 0, False
            elif len(codes) == size:
                close(False)
                block += 1
            same, last = row[:5] == last, row[:5]
            conv, begun = conv_id, True
            if (not first or same) and role_and_fault(code)[1] != BLANK:
                code = letter(role_and_fault(code)[0], DUPLICATE)
            codes.append(code)
            if turn is not None:
                turns[2] += turn != turns[1]
                turns[:2] = [turn if turns[0] is None else turns[0], turn]
        if len(out) >= 1000:
            yield made()
    if begun:
        close(False)
    if out:
        yield made()


_ENTRY = "array<struct<begin:string,end:string,cost:long,audit:string>>"
_SOLVED = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _solve(convs: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in convs:
        out = []
        for conv, pieces in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            faults, initial, n_turns, low, high = [0, 0, 0, 0], "", 0, None, None
            for p in pieces:
                faults = [x + y for x, y in zip(faults, counted(p["codes"], initial))]
                initial = role_and_fault(p["codes"][-1])[0]
                if p["n_turns"]:
                    n_turns += p["n_turns"] - (p["first_turn"] == high)
                    low, high = (p["first_turn"] if low is None else low), p["last_turn"]
            gaps = high - low + 1 - n_turns if n_turns else 0
            blocks = [{(i["begin"], i["end"]): (i["cost"], i["audit"]) for i in p["items"]} for p in pieces]
            cost, audit = blocks[0].get(("^", GOAL)) or joined(blocks)
            out.append((conv, gaps, *faults, cost, audit))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)


def _with_items(pieces: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The lightest derivations of each block, from every state that it may begin in."""
    for batch in pieces:
        items = []
        for codes, inner in zip(batch.column("codes").to_pylist(), batch.column("inner").to_pylist()):
            found = {("^", GOAL): lightest(codes)} if inner else block_items(codes)
            made = [(*ends, *item) for ends, item in found.items()]
            items.append([dict(zip(("begin", "end", "cost", "audit"), m)) for m in made])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(items, type=schema.field("items").type)], schema=schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Per conversation in order: ("begin", id, summary), then ("row", id, edit, role, text) for each row that is put out."""
    conv, begun, audit, at, state = None, False, "", 0, "^"

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, FOLLOWS[state][-1]
            yield "row", conv, "I", ROLES[state], ""

    for batch in batches:
        for row in batch.to_pylist():
            if not begun or row["conv"] != conv:
                if begun:
                    yield from inserted()
                conv, begun, audit, at, state = row["conv"], True, "", 0, "^"
                yield "begin", conv, None
            if row["kind"] == 1:
                audit = row["summary"]["audit"]
                yield "begin", conv, row["summary"]
            elif row["kind"] == 2:
                yield from inserted()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = row["role"][:1]
                    yield "row", conv, edit, row["role"], row["text"]
                elif edit == "R":
                    state = FOLLOWS[state][-1]
                    yield "row", conv, edit, ROLES[state], row["text"]
    if begun:
        yield from inserted()


def _digests(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, conv, summary, sha, rows, begun = [], None, None, None, 0, False
    names = schema.names[1:-2]

    def close():
        values = [summary[n] for n in names] if summary else [0] * (len(names) - 1) + [""]
        out.append((conv, *values, rows, sha.hexdigest()))

    def made():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
        return batch

    for event in _edited(batches):
        if event[0] == "begin":
            if event[2] is not None:
                summary = event[2]
                continue
            if begun:
                close()
                if len(out) >= 1000:
                    yield made()
            conv, summary, sha, rows, begun = event[1], None, hashlib.sha256(), 0, True
        else:
            sha.update((("\n" if rows else "") + event[3] + ":" + event[4]).encode("utf-8", "surrogatepass"))
            rows += 1
    if begun:
        close()
    if out:
        yield made()


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out, place, size = [], 0, 0

    def made():
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], type=f.type) for i, f in enumerate(schema)], schema=schema)
        out.clear()
        return batch

    for event in _edited(batches):
        if event[0] == "begin":
            place = 0
            continue
        out.append((event[1], place, *event[2:]))
        place, size = place + 1, size + len(event[4])
        if len(out) >= 10_000 or size > 8 << 20:
            yield made()
            size = 0
    if out:
        yield made()


def _mapped(df: DataFrame, worker, schema: StructType, *more) -> DataFrame:
    arrow = to_arrow_schema(schema)
    return df.mapInArrow(lambda batches: worker(batches, arrow, *more), schema)


def _schema(df: DataFrame, conv: str, rest: str) -> StructType:
    own = StructType().add("conv", df.schema[conv].dataType)
    return StructType([*own.fields, *StructType.fromDDL(rest).fields])


def _stream(rows: DataFrame, convs: DataFrame, block: int) -> DataFrame:
    """Every conversation's summary and rows, side by side and in order."""
    order = ["has_turn", "turn", "role", "sha"]
    digest = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("has_turn", F.col("turn").isNotNull()).withColumn("sha", digest)
    narrow = keep(rows.select("conv", *order, row_code(F.col("role"), F.col("text")).alias("code")), "turns")
    place = F.struct("has_turn", "turn")
    again = narrow.groupBy("conv", "sha").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1")
    again = again.select(F.col("conv").alias("of"), F.col("sha").alias("same"), "first")
    marked = narrow.join(again, F.col("conv").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("same")), "left")
    first = F.col("first").isNull() | place.eqNullSafe(F.col("first"))
    marked = marked.select("conv", *order, "code", first.alias("is_first"))
    dealt = marked.repartitionByRange("conv", *order).sortWithinPartitions("conv", *order)
    pieces = _mapped(dealt, _pieces, _schema(rows, "conv", _PIECES), block)
    pieces = _mapped(pieces, _with_items, _schema(rows, "conv", f"{_PIECES}, items {_ENTRY}"))
    piece = F.struct("part", "block", "codes", "first_turn", "last_turn", "n_turns", "items")
    grouped = pieces.groupBy("conv").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    solved = _mapped(grouped, _solve, _schema(rows, "conv", _SOLVED))
    parts = [
        convs.select("conv", F.lit(0).alias("kind")),
        solved.select("conv", F.lit(1).alias("kind"), F.struct(*solved.columns[1:]).alias("summary")),
        rows.select("conv", F.lit(2).alias("kind"), *order, "text"),
    ]
    every = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return every.repartition("conv").sortWithinPartitions("conv", "kind", *order)


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    some = lambda c: F.coalesce(F.col(c), F.lit(" "))
    return conversations.select(F.col(conv_id).alias("conv"), F.col(turn).cast("long").alias("turn"), some(role).alias("role"), some(text).alias("text"))


def repair(
    conversations: DataFrame, known: DataFrame | None = None, block: int = BLOCK,
    conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, n_rows, repaired_sha256) of every conversation.

    ``known`` has the ids of conversations that appear though they may have no
    rows.  gaps is the number of turns missing between the least and greatest
    one; illegal counts neighbours whose role initials are not su, ua or au.
    The digest is of the repaired ``role:text``, joined by newlines.
    """
    prepare(conversations.sparkSession)
    rows = _rows(conversations, conv_id, turn, role, text)
    convs = (known if known is not None else conversations).select(F.col(conv_id).alias("conv")).distinct()
    found = _mapped(_stream(rows, convs, block), _digests, _schema(rows, "conv", f"{_SOLVED}, n_rows long, repaired_sha256 string"))
    return found.withColumnRenamed("conv", conv_id)


def repaired_turns(
    conversations: DataFrame, block: int = BLOCK, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, place, edit, role, text): the rows of the repaired conversations, numbered from 0."""
    prepare(conversations.sparkSession)
    rows = _rows(conversations, conv_id, turn, role, text)
    found = _mapped(_stream(rows, rows.select("conv").distinct(), block), _turns, _schema(rows, "conv", "place long, edit string, role string, text string"))
    return found.withColumnRenamed("conv", conv_id)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, without ends of sentences, repeated or reroled, by the crc32 of conversation and turn."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(some("text"), "[.!?]", "")).otherwise(some("text"))
    role = F.when(h == 4, "user").otherwise(some("role"))
    copies = F.array_repeat(F.lit(0), F.when(h == 0, 0).when(h == 3, 2).otherwise(1).cast("int"))
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")
