"""Conversation structure repair by A* on the edit lattice.

A repaired conversation has role initials ``(s?(ua)+)?``. Edits of a row are Keep (0), Rerole to user or assistant (1) and Delete (2, required
for blank and duplicate rows); Insert adds an empty turn of user or assistant anywhere (5). A truncated row that stays adds 5.

A lattice node is (rows done, state of the pattern). The heuristic is the suffix sum of mandatory deletions and of the least charge of each
truncated row, which is never too high. The queue is keyed (cost plus heuristic, audit), so the first time a node leaves it, it has the least
cost and, of equal ones, the audit that is least in ASCII.

Spread over tasks: rows are range-partitioned by conversation, turn, role and text, so a long conversation goes to several tasks. Each task cuts
its rows into blocks of at most ``BLOCK_ROWS`` rows of one conversation. A conversation that is one block is solved at once. Of the others
each block is searched from each of the four states to each of the four, and only 16 costs and the order of 16 audits go on; a chain of these
small tables picks every block's states, and the blocks are edited in parallel again. Inserts come before the row that follows them, so a
block's audit ends with a row's letter, none of them is the beginning of another, and their order decides the order of whole audits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stored

BLOCK_ROWS, BLOCK_BYTES = 1024, 4 << 20
#: States: nothing yet, system only, after user, after assistant. The first and the last may end a conversation.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(EMPTY, "s"): SYSTEM, (EMPTY, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The turn that may follow each state, as inserts and reroles make it.
NEXT = ("u", "u", "a", "u")
ROLE = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What completes a conversation that ends in each state.
TAIL = ("", "II", "I", "")
FAR = 1 << 60
ORDINARY, BLANK, DUPLICATE, CUT = range(4)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text with the faults of the query's contract: by the checksum of ``conv_id:turn`` modulo 20, 0 drops a row, 1 empties its
    text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user. Nulls of role, text and in the checksum are one space."""
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    key = F.concat_ws(":", F.coalesce(conv.cast("string"), F.lit(" ")), F.coalesce(turn.cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = F.coalesce(F.col(role_col), F.lit(" ")), F.coalesce(F.col(text_col), F.lit(" "))
    rows = rows.select(
        conv.alias("conv_id"),
        turn.alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(role).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def initial(role: str) -> str:
    """The role's first character; an empty role has none and fits no pattern, as does a space."""
    return role[:1] or " "


def faults(roles: list[str], texts: list[str], known: Iterable[tuple[str, str]] = ()) -> list[int]:
    """Each row's first fault; ``known`` are (role, text) of earlier blocks."""
    seen, out = set(known), []
    for key in zip(roles, texts, strict=True):
        core = key[1].rstrip(SPACE)
        out.append(BLANK if not core else DUPLICATE if key in seen else ORDINARY if core[-1] in ".!?" else CUT)
        seen.add(key)
    return out


def search(initials: list[str], fault: list[int], state: int) -> list[tuple[int, str] | None]:
    """Least (cost, audit) from ``state`` over all rows to each state, without inserts after the last row; None where no edits lead there."""
    n = len(fault)
    rest = list(accumulate((0 if f == ORDINARY else DELETE for f in reversed(fault)), initial=0))[::-1]
    found: list[tuple[int, str] | None] = [None] * 4
    queue, done = [(rest[0], "", 0, state, 0)], set()
    while queue:
        _, audit, i, q, cost = heapq.heappop(queue)
        if (i, q) in done:
            continue
        done.add((i, q))
        if i == n:
            found[q] = (cost, audit)
            continue
        heapq.heappush(queue, (cost + INSERT + rest[i], audit + "I", i, STEP[q, NEXT[q]], cost + INSERT))
        heapq.heappush(queue, (cost + DELETE + rest[i + 1], audit + "D", i + 1, q, cost + DELETE))
        if fault[i] in (ORDINARY, CUT):
            stay = cost + (TRUNCATED if fault[i] == CUT else 0)
            heapq.heappush(queue, (stay + REROLE + rest[i + 1], audit + "R", i + 1, STEP[q, NEXT[q]], stay + REROLE))
            if (kept := STEP.get((q, initials[i]))) is not None:
                heapq.heappush(queue, (stay + KEEP + rest[i + 1], audit + "K", i + 1, kept, stay + KEEP))
    return found


def edited(roles: list[str], texts: list[str], audit: str, state: int) -> list[tuple[str, str, str, int | None]]:
    """(edit, role, text, row) of the turns that ``audit`` leaves, from ``state`` on; row is the place among ``roles``, None for inserts."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        letter = initial(roles[i]) if edit == "K" else NEXT[state]
        state = STEP[state, letter]
        out.append((edit, roles[i] if edit == "K" else ROLE[letter], "" if edit == "I" else texts[i], None if edit == "I" else i))
        i += edit != "I"
    return out


def finish(found: list[tuple[int, str] | None]) -> tuple[int, str]:
    """Least (cost, audit) of a whole conversation from what :func:`search` finds."""
    return min((x[0] + INSERT * len(TAIL[q]), x[1] + TAIL[q]) for q, x in enumerate(found) if x is not None)


BLOCKS = "conv_id long, block long, alone boolean, turns array<long>, roles array<string>, texts array<string>"


def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Stored blocks of conv_id, turn, role, text: by turn (nulls first), then role and text. alone: the block is the whole conversation for sure."""
    places = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    ranged = rows.repartitionByRange(*places, F.asc(F.substring("text", 1, 32))).sortWithinPartitions(*places, F.asc("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count, ready = TaskContext.get().partitionId(), 0, []
        conv, first, pieces, turns, roles, texts, size = None, True, 0, [], [], [], 0

        def close(alone: bool) -> None:
            nonlocal count, turns, roles, texts, size
            ready.append((conv, (part << 40) + count, alone, turns, roles, texts))
            count, turns, roles, texts, size = count + 1, [], [], [], 0

        def batch_of(out: list) -> pa.RecordBatch:
            names = ["conv_id", "block", "alone", "turns", "roles", "texts"]
            types = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        held, began = 0, False
        for batch in batches:
            for c, turn, role, text in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if began and c != conv:
                    close(pieces == 0 and not first)
                    first, pieces = False, 0
                elif len(turns) == block_rows or size > BLOCK_BYTES:
                    close(False)
                    pieces += 1
                conv, began = c, True
                turns.append(turn), roles.append(role), texts.append(text)
                size, held = size + len(text), held + len(text) + 50
                if ready and held > BLOCK_BYTES:
                    yield batch_of(ready)
                    ready.clear()
                    held = size
        if began:
            close(False)
        if ready:
            yield batch_of(ready)

    return stored(ranged.mapInArrow(run, BLOCKS), "conversation-blocks")


COUNTS = "lo long, hi long, n_turns long, blank long, duplicate long, truncated long, illegal long"


def counts(turns: list, roles: list[str], fault: list[int]) -> list:
    """Of sorted rows: least and greatest turn, distinct turns, the faults, adjacent initials that are not su, ua or au."""
    known = [t for t in turns if t is not None]
    letters = "".join(map(initial, roles))
    return [
        *((known[0], known[-1]) if known else (None, None)),
        len(set(known)),
        *(fault.count(f) for f in (BLANK, DUPLICATE, CUT)),
        sum(letters[i : i + 2] not in ("su", "ua", "au") for i in range(len(letters) - 1)),
    ]


def _records(out: list, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "int": pa.int32()}
    fields = [f.rsplit(" ", 1) for f in schema.split(", ")]
    columns = zip(*out, strict=True) if out else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), types[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def lines(turns: list[tuple]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text, _ in turns)


DIGEST = f"conv_id long, {COUNTS}, cost long, audit string, repaired_sha256 string"
TABLE = f"conv_id long, block long, first_turn long, last_turn long, first_role string, last_role string, {COUNTS}, costs array<long>, ranks array<long>"
CHOICE = f"conv_id long, block long, state int, after int, last int, {COUNTS}, cost long"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, turns, roles, texts in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            fault = faults(roles, texts)
            cost, audit = finish(search(list(map(initial, roles)), fault, EMPTY))
            digest = hashlib.sha256(lines(edited(roles, texts, audit, EMPTY)).encode()).hexdigest()
            out.append((conv, *counts(turns, roles, fault), cost, audit, digest))
        yield _records(out, DIGEST)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, turns, roles, texts, known in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            fault = faults(roles, texts, [(k["role"], k["text"]) for k in known or ()])
            found = [x for q in range(4) for x in search(list(map(initial, roles)), fault, q)]
            order = {a: r for r, a in enumerate(sorted({x[1] for x in found if x}))}
            out.append((conv, block, turns[0], turns[-1], roles[0], roles[-1], *counts(turns, roles, fault), [x[0] if x else FAR for x in found], [order[x[1]] if x else 0 for x in found]))
        yield _records(out, TABLE)


def chained(tables: list[list[int]], ranks: list[list[int]]) -> tuple[int, list[tuple[int, int]]]:
    """Cost and (state before, state after) of each block, of the least (cost, audit): least costs to the end first, then forward by the least rank."""
    left = [[INSERT * len(t) for t in TAIL]]
    for costs in reversed(tables):
        left.append([min(costs[4 * q + r] + left[-1][r] for r in range(4)) for q in range(4)])
    left.reverse()
    state, path = EMPTY, []
    for k, costs in enumerate(tables):
        after = min((ranks[k][4 * state + r], r) for r in range(4) if costs[4 * state + r] < FAR and costs[4 * state + r] + left[k + 1][r] == left[k][state])[1]
        path.append((state, after))
        state = after
    return left[0][EMPTY], path


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of rows of one conversation of sorted batches; conv_id is the first column."""
    conv, rows = None, []
    for batch in batches:
        for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row)
    if rows:
        yield conv, rows


def _choices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for conv, rows in _by_conversation(batches):
        cost, path = chained([r[13] for r in rows], [r[14] for r in rows])
        lo, hi = [r[6] for r in rows if r[6] is not None], [r[7] for r in rows if r[7] is not None]
        meet = list(zip(rows, rows[1:], strict=False))
        n_turns = sum(r[8] for r in rows) - sum(a[3] is not None and a[3] == b[2] for a, b in meet)
        illegal = sum(r[12] for r in rows) + sum(initial(a[5]) + initial(b[4]) not in ("su", "ua", "au") for a, b in meet)
        whole = [min(lo, default=None), max(hi, default=None), n_turns, *(sum(r[c] for r in rows) for c in (9, 10, 11)), illegal, cost]
        yield _records([(conv, r[1], *states, int(k == len(rows) - 1), *whole) for k, (r, states) in enumerate(zip(rows, path, strict=True))], CHOICE)


PIECE = f"conv_id long, block long, {COUNTS}, cost long, audit string, text string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, roles, texts, known, state, after, last, *whole in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            fault = faults(roles, texts, [(k["role"], k["text"]) for k in known or ()])
            audit = search(list(map(initial, roles)), fault, state)[after][1] + (TAIL[after] if last else "")
            out.append((conv, block, *whole, audit, lines(edited(roles, texts, audit, state))))
        yield _records(out, PIECE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted pieces; the text goes through the hash piece by piece."""
    conv, whole, audit, sha, begun = None, None, [], hashlib.sha256(), False
    for batch in batches:
        for row in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            if whole is not None and row[0] != conv:
                yield _records([(conv, *whole, "".join(audit), sha.hexdigest())], DIGEST)
                audit, sha, begun = [], hashlib.sha256(), False
            conv, whole, text = row[0], row[2:-2], row[-1]
            audit.append(row[-2])
            if text:
                sha.update(f"\n{text}".encode() if begun else text.encode())
                begun = True
    if whole is not None:
        yield _records([(conv, *whole, "".join(audit), sha.hexdigest())], DIGEST)


def _known(parts: DataFrame) -> DataFrame:
    """conv_id, block, known: the (role, text) of earlier blocks of the conversation that this one has again."""
    each = parts.select("conv_id", "block", F.explode(F.array_distinct(F.arrays_zip("roles", "texts"))).alias("row"))
    firsts = each.groupBy("conv_id", "row").agg(F.min("block").alias("block"))
    # A row of a block is known unless the block is its first; the blocks that have it meet their rows again on unique keys.
    again = each.join(firsts, ["block", "row"], "left_anti")
    return again.groupBy("conv_id", "block").agg(F.collect_list(F.struct(F.col("row.roles").alias("role"), F.col("row.texts").alias("text"))).alias("known"))


def planned(found: DataFrame) -> DataFrame:
    """Blocks that are not known to be whole conversations, with the known rows and the choice of the chain. Block numbers are unique."""
    parts = found.filter(~F.col("alone"))
    known = _known(parts)
    parts = parts.join(known.drop("conv_id"), "block", "left")
    tables = parts.select("conv_id", "block", "turns", "roles", "texts", "known").mapInArrow(_tables, TABLE)
    chain = tables.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_choices, CHOICE)
    return parts.drop("alone").join(stored(chain, "conversation-choices").drop("conv_id"), "block")


def audits(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per conversation of conv_id, turn, role, text (no nulls in role and text): lo, hi, n_turns (distinct), blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256. Null ids are one conversation, null turns come first; an empty table gives no rows.

    The audit and the hash of a conversation are sequential by definition: its letters and its repaired text meet in one task, the text
    as a stream of blocks.
    """
    found = blocks(rows, block_rows)
    whole = found.filter("alone").select("conv_id", "turns", "roles", "texts").mapInArrow(_solved, DIGEST)
    counted = [f.split()[0] for f in COUNTS.split(", ")]
    pieces = planned(found).select("conv_id", "block", "roles", "texts", "known", "state", "after", "last", *counted, "cost").mapInArrow(_pieces, PIECE)
    return whole.unionByName(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(_digests, DIGEST))


TURNS = "conv_id long, block long, seq int, turn long, role string, text string, edit string"


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, block, turns, roles, texts, known, state, after, last in zip(*[x.to_pylist() for x in batch.columns], strict=True):
            found = search(list(map(initial, roles)), faults(roles, texts, [(k["role"], k["text"]) for k in known or ()]), state)
            audit = finish(found)[1] if after is None else found[after][1] + (TAIL[after] if last else "")
            out += [(conv, block, seq, None if i is None else turns[i], role, text, edit) for seq, (edit, role, text, i) in enumerate(edited(roles, texts, audit, state))]
        yield _records(out, TURNS)


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The turns of all repaired conversations, in the order of (block, seq): conv_id, block, seq, turn (null for inserts), role, text, edit (K, R or I)."""
    found = blocks(rows, block_rows)
    names = ["conv_id", "block", "turns", "roles", "texts", "known", "state", "after", "last"]
    none = {"known": F.lit(None).cast("array<struct<role:string,text:string>>"), "state": F.lit(EMPTY), "after": F.lit(None).cast("int"), "last": F.lit(1)}
    whole = found.filter("alone").withColumns(none).select(*names)
    return whole.unionByName(planned(found).select(*names)).mapInArrow(_turns, TURNS)


def repair_report(conversations: DataFrame, rows: DataFrame, conv_col: str = "conv_id", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """A row per conversation of ``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of its ``rows``;
    zeros, an empty audit and the hash of an empty text where it has no rows."""
    ids = conversations.select(F.col(conv_col).cast("long").alias("conv_id")).distinct()
    got = audits(rows, block_rows)
    joined = ids.alias("i").join(got.alias("g"), F.col("i.conv_id").eqNullSafe(F.col("g.conv_id")), "left")
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return joined.select(
        "i.conv_id",
        number(F.col("hi") - F.col("lo") + 1 - F.col("n_turns")).alias("gaps"),
        *[number(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
