"""Minimum-cost repair of the roles in conversations, then rendering.

The legal sequences are those of a small automaton: an optional system turn, then user and
assistant in turn, an assistant at the end. A turn may be taken as it is, relabelled, or
merged into the turn before, and empty turns may be inserted; dynamic programming finds the
cheapest repair.

A conversation may be of any length. Its turns are sorted over all tasks and cut into chunks; each chunk is
summed up as the cost from every entry state to every exit state (a min-plus matrix); the
matrices of a conversation are multiplied in order, which fixes the states at the chunk borders;
then every chunk finds its own turns.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tracewright.plans.tables import materialize

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
INF = float("inf")
CHUNK = 512


@dataclass(frozen=True)
class Costs:
    """What a change costs. ``relabel`` between user and assistant, ``relabel_system`` to or from
    system, ``unknown`` to give a role to a turn without a known one."""
    merge: float = 1.0
    merge_other: float = 1.5
    relabel: float = 2.0
    relabel_system: float = 3.0
    unknown: float = 0.5
    insert: float = 3.0


def relabel_cost(role: int, to: int, costs: Costs) -> float:
    if role == START:                              # null or unknown
        return costs.unknown
    if role == to:
        return 0.0
    return costs.relabel_system if SYSTEM in (role, to) else costs.relabel


def moves(costs: Costs) -> dict[tuple[int, int], list[tuple[float, int, int, tuple[int, ...]]]]:
    """(state, role) -> possible (cost, next state, merged, inserted roles), cheapest first. A
    merge keeps the state. Ties are decided by this order, so results are the same everywhere."""
    out = {}
    for state in range(4):
        for role in range(4):
            options = []
            if state != START:
                change = relabel_cost(role, state, costs)
                options.append((change + (costs.merge_other if change else costs.merge), state, 1, ()))
            for a in NEXT[state]:
                options.append((relabel_cost(role, a, costs), a, 0, ()))
                for b in NEXT[a]:
                    options.append((costs.insert + relabel_cost(role, b, costs), b, 0, (a,)))
            out[state, role] = sorted(options)
    return out


def finish(state: int, costs: Costs) -> tuple[float, tuple[int, ...]]:
    """Cost and inserted turns that make ``state`` a legal end."""
    ends = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]
    return costs.insert * len(ends), ends


def forward(roles: list[int], entry: int, table: dict) -> tuple[list[float], list[int], list[list]]:
    """From ``entry``: for every state its cost and its number of new turns after the
    roles, and the back pointers."""
    cost, new = [INF] * 4, [0] * 4
    cost[entry] = 0.0
    back = []
    for role in roles:
        best: list = [None] * 4
        for state in range(4):
            if cost[state] < INF:
                for c, to, merged, inserted in table[state, role]:
                    made = new[state] + (0 if merged else 1 + len(inserted))
                    key = (cost[state] + c, made, state, merged, inserted)
                    if best[to] is None or key < best[to]:
                        best[to] = key
        cost = [INF if b is None else b[0] for b in best]
        new = [0 if b is None else b[1] for b in best]
        back.append(best)
    return cost, new, back


def path(roles: list[int], entry: int, exit_state: int, table: dict) -> list[tuple[int, int, tuple[int, ...]]]:
    """(state, merged, inserted) of every turn on the cheapest way from entry to exit."""
    _, _, back = forward(roles, entry, table)
    out, state = [], exit_state
    for best in reversed(back):
        _, _, before, merged, inserted = best[state]
        out.append((state, merged, inserted))
        state = before
    return out[::-1]


def escape(text: str) -> str:
    """A text that opens no turn of its own: every ``<|`` gets a second bar, which marks never have. ``unescape`` undoes it."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


def _role_code(role) -> int:
    return ROLES.index(role) if role in ROLES[1:] else START


def _sorted_chunks(turns: DataFrame, chunk: int) -> DataFrame:
    """The turns with part (sorted over all tasks), chunk and row numbers. Every chunk lies in one part
    and belongs to one conversation."""
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, at = None, 0
        for batch in batches:
            chunks, rows = [], []
            for key in batch["conv"].tolist():
                if key != current:
                    current, at = key, 0
                chunks.append(at // chunk)
                rows.append(at % chunk)
                at += 1
            yield batch.assign(chunk=chunks, row=rows)[["conv", "part", "chunk", "row", "role", "text"]]

    # a null id is one conversation; as text it cannot clash with a number
    rows = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn",
                        F.lower(F.trim("role")).alias("role"), "text")
    order = ["conv", F.col("turn").asc_nulls_last(), "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    out = rows.select("conv", "part", "role", "text").mapInPandas(
        number, "conv string, part int, chunk long, row long, role string, text string")
    return materialize(out, "turns")


def _by_key(batches: Iterator[pd.DataFrame], n_keys: int, one, columns: list[str]) -> Iterator[pd.DataFrame]:
    """Apply ``one(key, rows)`` to the runs of rows with equal first columns, across batches."""
    rows = (row for batch in batches for row in zip(*(batch[c].tolist() for c in batch.columns)))
    held: list = []
    for k, group in groupby(rows, key=lambda row: row[:n_keys]):
        held += one(k, group)
        if len(held) >= 8192:
            yield pd.DataFrame(held, columns=columns)
            held = []
    if held:
        yield pd.DataFrame(held, columns=columns)


def repair(turns: DataFrame, costs: Costs = Costs(), chunk: int = CHUNK) -> DataFrame:
    """Repaired and rendered turns of all conversations (conv_id, turn, role, text).

    One row per input turn and per inserted turn: conv_id, position (of the turn in the repaired
    sequence), part (0 opens the turn, above 0 are merged pieces in order), role, action (keep, relabel, merge,
    insert), rendered, last, cost. Marks inside texts are escaped. The ``rendered`` pieces in order of (position, part) are the
    conversation's text, closed by the row with ``last``; cost is that of the whole conversation.

    Turns are ordered by turn (nulls last), then role and text, so repeated rows are repeated turns. A null
    text is empty; null or unknown roles get the cheapest one; null conv_ids form one
    conversation. Empty tables give empty results; other columns are ignored.
    """
    table = moves(costs)
    rows = _sorted_chunks(turns, chunk)
    key = ["conv", "part", "chunk"]

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(k, group):
            roles = [_role_code(r[4]) for r in group]
            runs = [forward(roles, s, table) for s in range(4)]
            return [(*k, [c for r in runs for c in r[0]], [n for r in runs for n in r[1]])]
        return _by_key(batches, 3, one, [*key, "costs", "made"])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(k, group):
            group = list(group)
            best, back = {START: (0.0, 0)}, []      # state -> cost, turns so far
            for _, _, _, cost, made in group:
                ahead: dict = {}
                for s, (c, n) in best.items():
                    for t in range(4):
                        option = (c + cost[4 * s + t], n + made[4 * s + t], s)
                        if option[0] < INF and (t not in ahead or option < ahead[t]):
                            ahead[t] = option
                back.append(ahead)
                best = {t: (c, n) for t, (c, n, _) in ahead.items()}
            total, _, state = min((c + finish(s, costs)[0], n, s) for s, (c, n) in best.items())
            borders = [state]
            for ahead in reversed(back):
                borders.append(ahead[borders[-1]][2])
            borders.reverse()
            out, n = [], 0
            for i, (conv, part, number, _, made) in enumerate(group):
                out.append((conv, part, number, i, borders[i], borders[i + 1], n, i == len(group) - 1, total))
                n += made[4 * borders[i] + borders[i + 1]]
            return out
        return _by_key(batches, 1, one, [*key, "seq", "entry", "exit", "before", "final", "cost"])

    def render(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(k, group):
            group = list(group)
            roles = [_role_code(r[4]) for r in group]
            seq, entry, exit_state, before, final, cost = group[0][6:]
            at, part, out = before - 1, seq << 32, []

            def add(state: int, action: str, text: str) -> None:
                head = ("<|end|>\n" if at else "") + f"<|{ROLES[state]}|>\n" if action != "merge" else "\n\n"
                out.append([k[0], at, part, ROLES[state], action, head + text, False, cost])

            for (state, merged, inserted), role, row in zip(path(roles, entry, exit_state, table), roles, group):
                for x in inserted:
                    at, part = at + 1, 0
                    add(x, "insert", "")
                at, part = (at, part + 1) if merged else (at + 1, 0)
                add(state, "merge" if merged else "keep" if role == state else "relabel", escape(row[5] or ""))
            if final:
                for x in finish(exit_state, costs)[1]:
                    at, part = at + 1, 0
                    add(x, "insert", "")
                out[-1][6] = True
                out[-1][5] += "<|end|>\n"
            return out
        return _by_key(batches, 3, one, ["conv", "position", "part", "role", "action", "rendered", "last", "cost"])

    parts = rows.select(*key, "row", "role").repartition(*key).sortWithinPartitions(*key, "row")
    summaries = parts.mapInPandas(summarise, "conv string, part int, chunk long, costs array<double>, made array<long>")
    states = summaries.repartition("conv").sortWithinPartitions(*key).mapInPandas(
        fold, "conv string, part int, chunk long, seq long, entry int, exit int, before long, final boolean, cost double")
    joined = rows.join(states, key).select(*key, "row", "role", "text", "seq", "entry", "exit", "before", "final", "cost")
    out = joined.repartition(*key).sortWithinPartitions(*key, "row").mapInPandas(
        render, "conv string, position long, part long, role string, action string, rendered string, last boolean, "
                "cost double")
    return out.select(F.when(F.col("conv") != "", F.col("conv")).cast(turns.schema["conv_id"].dataType)
                      .alias("conv_id"), "position", "part", "role", "action", "rendered", "last", "cost")
