"""Chat formatting with minimum-cost role repair.

Legal sequences are an automaton: an optional system turn, then user and assistant in turn, ending with the
assistant.  Each turn of the input may keep its role or be given another one, be merged with the turn before it
when both have the same role, or have one empty turn inserted before it; an empty turn may close the
conversation.  Dynamic programming over the automaton's states finds the cheapest repair.

A turn is a min-plus matrix over the states, and matrices compose, so a conversation is cut into chunks of
``CHUNK`` turn numbers: each chunk gives the matrix of its turns, the matrices of a conversation fix the states at
the chunks' ends, and each chunk is then repaired on its own.  A conversation of any length is never gathered;
rows that share a number, null ones too, are cut by role and by ranges of a hash of their text.

Defined cases: identical rows count once; turns with the same number are ordered by role and a hash of their text;
control tokens in a text are escaped (``escaped``, undone by ``unescaped``); null turn numbers come last, null roles are unknown ones (relabelled at a cost of 1), null texts are empty; a null
conversation id is a conversation of its own; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import spread_join
from .common import lean, save, table

CHUNK = 1024
#: Rows from which on the turns of a chunk, which may share their numbers, are dealt to several.
FULL = 4 * CHUNK
#: States: the role of the last turn written.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ("", "system", "user", "assistant")
#: Other names of the roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
KEEP, MERGE, RELABEL, INSERT, UNKNOWN = 0, 1, 2, 3, 1
FAR = 1 << 40


def role_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), START)


def moves(state: int, role: int) -> list[tuple[int, int, int, bool]]:
    """(cost, new state, role inserted before or 0, merged) of one turn of ``role`` (0: unknown) after ``state``."""
    out = []
    for to in (SYSTEM, USER, ASSISTANT):
        cost = KEEP if to == role else UNKNOWN if role == START else RELABEL
        if to in NEXT[state]:
            out.append((cost, to, 0, False))
        if to == state:
            out.append((cost + MERGE, to, 0, True))
        out += [(cost + INSERT, to, via, False) for via in NEXT[state] if to in NEXT[via]]
    return out


#: The cheapest move between any two states for a turn of each role, ties to the first listed.
BEST = {(s, r): {to: min(m for m in moves(s, r) if m[1] == to) for to in {m[1] for m in moves(s, r)}} for s in range(4) for r in range(4)}
#: Cost to end in a state: an empty assistant turn, before it an empty user turn after a system turn.
END = (0, 2 * INSERT, INSERT, 0)
CLOSING = ((), (USER, ASSISTANT), (ASSISTANT,), ())


def chunk_costs(roles: list[int]) -> list[int]:
    """The min-plus matrix of a run of turns, row by row."""
    out = []
    for start in range(4):
        cost = [FAR] * 4
        cost[start] = 0
        for r in roles:
            new = [FAR] * 4
            for s in range(4):
                if cost[s] < FAR:
                    for to, m in BEST[s, r].items():
                        new[to] = min(new[to], cost[s] + m[0])
            cost = new
        out += cost
    return out


def ends(matrices: list[list[int]]) -> list[tuple[int, int]]:
    """(state before, state after) of each chunk on a cheapest path from START to a legal end."""
    costs = [[0, FAR, FAR, FAR]]
    for m in matrices:
        costs.append([min(costs[-1][s] + m[4 * s + t] for s in range(4)) for t in range(4)])
    state = min(range(4), key=lambda t: (costs[-1][t] + END[t], t))
    out = []
    for i in range(len(matrices) - 1, -1, -1):
        before = min(range(4), key=lambda s: (costs[i][s] + matrices[i][4 * s + state], s))
        out.append((before, state))
        state = before
    return out[::-1]


def repair(roles: list[int], start: int = START, stop: int | None = None) -> list[tuple[int, int, bool]]:
    """(role, role inserted before or 0, merged) of each turn, cheapest from ``start`` to ``stop`` (or any legal end)."""
    cost, back = [0 if s == start else FAR for s in range(4)], []
    for r in roles:
        new, came = [FAR] * 4, [0] * 4
        for s in range(4):
            if cost[s] < FAR:
                for to, m in BEST[s, r].items():
                    if cost[s] + m[0] < new[to]:
                        new[to], came[to] = cost[s] + m[0], s
        cost = new
        back.append(came)
    state = stop if stop is not None else min(range(4), key=lambda t: (cost[t] + END[t], t))
    out = []
    for r, came in zip(reversed(roles), reversed(back), strict=True):
        s = came[state]
        m = BEST[s, r][state]
        out.append((state, m[2], m[3]))
        state = s
    return out[::-1]


def escaped(text: str) -> str:
    """Text in which no control token stands: "<|" becomes "<\\|", and a backslash is added where there are some."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def turn_text(role: int, text: str = "") -> str:
    return f"<|im_start|>{ROLES[role]}\n{escaped(text)}"


CLOSE = "<|im_end|>\n"


def _by_key(batches, n_keys: int):
    """Runs of equal leading columns of sorted batches: (key, rows); a run may be as long as a chunk."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:n_keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:n_keys], []
            rows.append(row[n_keys:])
    if rows:
        yield key, rows


#: What names a chunk: its turn numbers and, where more rows than ``FULL`` share these, one of them, a role and a range of hashes.
PARTS = ("conv_id", "chunk", "p_turn", "p_role", "p_hash")
PART_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
PART_SCHEMA = "conv_id long, chunk long, p_turn long, p_role string, p_hash long"


def _order():
    return [*(F.asc_nulls_first(c) for c in PARTS), F.asc_nulls_last("turn"), F.asc_nulls_first("role"), F.asc("mark"), F.asc("text")]


def chunked(turns: DataFrame) -> DataFrame:
    """Distinct turns with their chunk: ``CHUNK`` turn numbers, or less where many rows share a number."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    rows = rows.withColumns({"chunk": F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit((1 << 62) // CHUNK)), "mark": F.xxhash64("text")})
    rows, _ = save(rows.withColumn("key", F.xxhash64("conv_id", "chunk")), "turns")
    full = rows.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).alias("parts"), F.count("*").alias("n")).where(F.col("n") > FULL).select("key", "parts")
    rows = spread_join(rows, full, "key", "mark", "left")
    split = F.col("parts").isNotNull()
    # the order of a chunk is by turn, role and hash, so ranges of these are runs of it
    hashed = F.floor(F.shiftright("mark", 32) / F.ceil(F.lit(float(1 << 32)) / F.col("parts")))
    return rows.select("conv_id", "chunk", F.when(split, F.col("turn")).alias("p_turn"), F.when(split, F.col("role")).alias("p_role"), F.when(split, hashed).alias("p_hash"), "turn", "role", "mark", "text")


def _repairs(turns: DataFrame, emit, schema: str) -> DataFrame:
    """``emit(part, done, run, before, final)`` batches of every repaired chunk."""
    rows, _ = save(chunked(turns), "chunks")
    n = len(PARTS)

    def matrices(batches):
        for key, run in _by_key(batches, n):
            yield pa.record_batch([pa.array([x], t) for x, t in zip(key, PART_TYPES, strict=True)] + [pa.array([chunk_costs([role_of(r[1]) for r in run])], pa.list_(pa.int64()))], [*PARTS, "m"])

    costs = rows.repartition(*PARTS).sortWithinPartitions(*_order()).select(*PARTS, "turn", "role").mapInArrow(lean(matrices), f"{PART_SCHEMA}, m array<long>")

    def states(batches):
        for (conv,), run in _by_key(batches, 1):
            found = ends([r[-1] for r in run])
            columns = [[conv] * len(run), *zip(*(r[:-1] for r in run), strict=True)]
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, PART_TYPES, strict=True)] + [pa.array([a for a, _ in found], pa.int32()), pa.array([b for _, b in found], pa.int32()), pa.array([i == len(run) - 1 for i in range(len(run))])], [*PARTS, "before", "after", "final"])

    fixed = costs.repartition("conv_id").sortWithinPartitions(*(F.asc_nulls_first(c) for c in PARTS)).mapInArrow(lean(states), f"{PART_SCHEMA}, before int, after int, final boolean")
    fixed = fixed.select(*(F.col(c).alias(f"_{c}") for c in PARTS), "before", "after", "final")
    same = [rows[c].eqNullSafe(fixed[f"_{c}"]) for c in PARTS]
    joined = rows.join(fixed, same[0] & same[1] & same[2] & same[3] & same[4])

    def render(batches):
        for key, run in _by_key(batches, n):
            before, after, final = run[0][3:]
            yield emit(key, repair([role_of(r[1]) for r in run], before, after), run, before, final)

    return joined.repartition(*PARTS).sortWithinPartitions(*_order()).select(*PARTS, "turn", "role", "text", "before", "after", "final").mapInArrow(lean(render), schema)


def _pieces(done, run, before: int, final: bool):
    """The text of each turn of a chunk, with what is inserted before it and what closes the conversation."""
    for i, ((role, via, merged), (_, _, text, *_)) in enumerate(zip(done, run, strict=True)):
        piece = f"\n{escaped(text)}" if merged else (CLOSE if before != START else "") + (turn_text(via) + CLOSE if via else "") + turn_text(role, text)
        if final and i == len(run) - 1:
            piece += CLOSE + "".join(turn_text(r) + CLOSE for r in CLOSING[role])
        before = role
        yield piece


def repaired(turns: DataFrame) -> DataFrame:
    """One row for each turn: its chunk and place in it, the role given and repaired, what was done, and its piece of text.

    The pieces of a conversation in the order of ``PARTS`` and place make the rendered, repaired sequence.
    """

    def emit(key, done, run, before, final):
        out = []
        for i, ((role, via, merged), (turn, name, *_), piece) in enumerate(zip(done, run, _pieces(done, run, before, final), strict=True)):
            action = "+".join(x for x, y in (("insert", via), ("merge", merged), ("relabel", role != role_of(name))) if y) or "keep"
            out.append((*key, turn, i, name, ROLES[role], ROLES[via] or None, merged, action, piece))
        types = [*PART_TYPES, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.string()]
        return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [*PARTS, "turn", "place", "role_in", "role", "inserted", "merged", "action", "piece"])

    return _repairs(turns, emit, f"{PART_SCHEMA}, turn long, place long, role_in string, role string, inserted string, merged boolean, action string, piece string")


def formatted(turns: DataFrame) -> DataFrame:
    """The repaired, rendered conversations: one row each, or one for each chunk where they are longer than one.

    (conv_id, chunk, ..., turns, kept, relabelled, merged, inserted, text): ``inserted`` counts empty turns, those
    that close the conversation too.  Texts are escaped, so that no turn can be forged in them.
    """

    def emit(key, done, run, before, final):
        relabelled = sum(role != role_of(name) for (role, _, _), (_, name, *_) in zip(done, run, strict=True))
        merged, inserted = sum(m for _, _, m in done), sum(v > 0 for _, v, _ in done) + (len(CLOSING[done[-1][0]]) if final else 0)
        kept = sum(role == role_of(name) and not merged and not via for (role, via, merged), (_, name, *_) in zip(done, run, strict=True))
        row = (*key, len(run), kept, relabelled, merged, inserted, "".join(_pieces(done, run, before, final)))
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, [*PART_TYPES, *[pa.int64()] * 5, pa.string()], strict=True)], [*PARTS, "turns", "kept", "relabelled", "merged", "inserted", "text"])

    return _repairs(turns, emit, f"{PART_SCHEMA}, turns long, kept long, relabelled long, merged long, inserted long, text string")


def rendered(pieces: DataFrame) -> DataFrame:
    """(conv_id, text) of conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct(*PARTS, "place", "piece")))
    return pieces.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    return formatted(table(spark, sf_dir, "conversations"))
