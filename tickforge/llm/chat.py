"""Minimum-cost repair of the roles of conversations, and their rendering."""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, numbered, saved

#: States of the automaton: nothing said yet, or the role of the turn said last.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Which turn may follow which state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: States in which a conversation may end.
ENDS = (START, ASSISTANT)
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1  # into a turn of the same role
    merge_other: int = 4  # into a turn of another role
    relabel: int = 3
    label: int = 1  # of a turn whose role is null or unknown
    insert: int = 2  # an empty turn


def steps(costs: Costs):
    """steps[role][state]: what may be done with a turn of that role, as (state after, cost, inserted roles, action), best first."""
    fill = {s: {s: ()} for s in range(4)}  # state -> state reached by empty turns -> the turns, fewest first
    for s in range(4):
        edge = [s]
        while edge:
            x = edge.pop(0)
            for y in NEXT[x]:
                if y not in fill[s] and y != SYSTEM:
                    fill[s][y] = (*fill[s][x], y)
                    edge.append(y)
    out: list[list[list[tuple]]] = []
    for role in range(4):  # 0: unknown
        by_state = []
        for s in range(4):
            options = []
            if s != START:
                options.append((s, costs.merge if s == role else costs.label + costs.merge if not role else costs.merge_other, (), "merge"))
            for mid, empty in fill[s].items():
                for to in NEXT[mid]:
                    own = 0 if to == role else costs.label if not role else costs.relabel
                    options.append((to, own + costs.insert * len(empty), empty, "keep" if to == role else "relabel"))
            by_state.append(sorted(options, key=lambda o: (o[1], len(o[2]), o[3], o[0])))
        out.append(by_state)
    return out, fill


def cost_matrix(roles: list[int], table) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    cost = np.full((4, 4), FAR, np.int64)
    np.fill_diagonal(cost, 0)
    for role in roles:
        new = np.full((4, 4), FAR, np.int64)
        for s in range(4):
            for to, c, _, _ in table[role][s]:
                new[:, to] = np.minimum(new[:, to], cost[:, s] + c)
        cost = new
    return cost


def end_costs(fill, costs: Costs) -> np.ndarray:
    """What it costs in each state to reach an end by empty turns."""
    return np.array([min(costs.insert * len(fill[s][e]) for e in ENDS if e in fill[s]) for s in range(4)], np.int64)


def best_path(roles: list[int], entry: int, last: int | None, table, fill, costs: Costs):
    """The cheapest steps for the turns from state `entry` to state `last`, or to any end if that is None; and the end's empty turns."""
    cost = [FAR] * 4
    cost[entry] = 0
    back: list[list] = []
    for role in roles:
        new, how = [FAR] * 4, [None] * 4
        for s in range(4):
            if cost[s] < FAR:
                for option in table[role][s]:
                    if cost[s] + option[1] < new[option[0]]:
                        new[option[0]], how[option[0]] = cost[s] + option[1], (s, option)
        back.append(how)
        cost = new
    tail: tuple = ()
    if last is None:
        ending = end_costs(fill, costs)
        last = min(range(4), key=lambda s: cost[s] + ending[s])
        tail = min((fill[last][e] for e in ENDS if e in fill[last]), key=len)
    path = []
    for how in reversed(back):
        last, option = how[last]
        path.append(option)
    return path[::-1], tail


def escaped(text: Column) -> Column:
    """The text with one backslash more in whatever reads as a marker of turns, so that it cannot begin or end one.

    <|im_end|> becomes <|\\im_end|>, and that one more; taking one away from each gives the text back.
    """
    return F.regexp_replace(text, r"<\|(\\*im_(?:start|end)\|>)", r"<|\\$1")


def repair(turns: DataFrame, costs: Costs = Costs(), block: int = 4096) -> DataFrame:
    """(conv_id, turn, place, sub, action, role, cost, piece) of the repaired conversations.

    A legal conversation is an optional system turn, then user and assistant in turn, the
    assistant last. Turns of conv_id in the order of `turn` (nulls first, ties as they are
    read) are kept, relabelled or merged into the turn before, and empty turns are
    inserted, so that the sum of costs is least; of equal ones the first in the order
    of steps() is taken. A null or other role costs a label. Null text is empty; markers of
    turns that stand in a text are escaped().

    One row for each turn of the input, and one (turn null, action "insert") for each
    inserted; in the order of (place, sub) their pieces join to the rendered
    conversation. A null conv_id is a conversation like any other. No rows give none.

    Turns are numbered in their order and dealt in blocks of `block`. A conversation
    that spans blocks, however long, is solved from each block's matrix of least costs
    from state to state (their min-plus product), then each block by itself between
    the states so found; the rest is solved inside its block.
    """
    table, fill = steps(costs)
    known = F.create_map(*[x for i, r in enumerate(ROLES) if r for x in (F.lit(r), F.lit(i))])
    rows = saved(
        turns.select(
            "conv_id",
            "turn",
            F.coalesce(F.try_element_at(known, F.coalesce("role", F.lit(""))), F.lit(0)).alias("role"),
            escaped(F.coalesce("text", F.lit(""))).alias("text"),
            F.monotonically_increasing_id().alias("_row"),
        )
    )
    rows = numbered(rows, ["conv_id", "turn", "_row"], "place").withColumn("block", F.floor(F.col("place") / block))
    conv = turns.schema["conv_id"].dataType

    # Segments that meet in a conversation which goes on over the end of a block.
    seg = rows.groupBy("conv_id").agg(F.min("block").alias("first"), F.max("block").alias("last")).where("first < last")
    # At most two in each block, so one such table is small against the rows; a conversation has one row in it.
    spread = rows.select("conv_id", "block", "place", "role").join(seg.withColumnRenamed("conv_id", "_conv"), F.expr("conv_id <=> _conv"))

    def matrix(t: pa.Table) -> pa.Table:
        roles = t.sort_by("place").column("role").to_pylist()
        return pa.Table.from_arrays(
            [t.column("conv_id").slice(0, 1), t.column("block").slice(0, 1), t.column("last").slice(0, 1), pa.array([cost_matrix(roles, table).ravel().tolist()])],
            names=["conv_id", "block", "last", "costs"],
        )

    matrices = spread.groupBy("conv_id", "block").applyInArrow(matrix, f"conv_id {conv.simpleString()}, block long, last long, costs array<long>")

    def states(t: pa.Table) -> pa.Table:
        t = t.sort_by("block")
        each = [np.array(x).reshape(4, 4) for x in t.column("costs").to_pylist()]
        cost, back = np.array([0, FAR, FAR, FAR]), []
        for m in each:
            total = cost[:, None] + m
            back.append(total.argmin(axis=0))
            cost = total.min(axis=0)
        at = [int((cost + end_costs(fill, costs)).argmin())]
        for b in reversed(back):
            at.append(int(b[at[-1]]))
        at = at[::-1]
        ends = [x if i < len(each) - 1 else None for i, x in enumerate(at[1:])]
        return pa.Table.from_arrays([t.column("conv_id"), t.column("block"), pa.array(at[:-1], pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "block", "entry", "leave"])

    bounds = matrices.groupBy("conv_id").applyInArrow(states, f"conv_id {conv.simpleString()}, block long, entry int, leave int")

    names = ["conv_id", "turn", "place", "sub", "action", "role", "cost", "piece"]

    def solve(t: pa.Table, b: pa.Table) -> pa.Table:
        t = t.sort_by("place")
        given = {c: (e, x) for c, e, x in zip(*(b.column(n).to_pylist() for n in ("conv_id", "entry", "leave")))}
        out: list[tuple] = []
        conv, turn, place, role, text = (t.column(n).to_pylist() for n in ("conv_id", "turn", "place", "role", "text"))
        i = 0
        while i < len(conv):
            j = i
            while j < len(conv) and conv[j] == conv[i]:
                j += 1
            entry, leave = given.get(conv[i], (START, None))
            path, tail = best_path(role[i:j], entry, leave, table, fill, costs)
            state = entry
            begin = lambda s, r: ("<|im_end|>\n" if s != START else "") + f"<|im_start|>{ROLES[r]}\n"
            for n, (to, cost, empty, action) in zip(range(i, j), path):
                for k, r in enumerate(empty):
                    out.append((conv[i], None, place[n], k, "insert", ROLES[r], costs.insert, begin(state, r)))
                    state = r
                piece = "\n" + text[n] if action == "merge" else begin(state, to) + text[n]
                out.append((conv[i], turn[n], place[n], len(empty), action, ROLES[to], cost - costs.insert * len(empty), piece))
                state = to
            for k, r in enumerate(tail):
                out.append((conv[i], None, place[j - 1], 10 + k, "insert", ROLES[r], costs.insert, begin(state, r)))
                state = r
            if leave is None and out:
                out[-1] = (*out[-1][:-1], out[-1][-1] + "<|im_end|>\n")
            i = j
        kinds = [t.schema.field("conv_id").type if len(t) else pa.int64(), t.schema.field("turn").type, pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.string()]
        return pa.Table.from_arrays([pa.array([r[n] for r in out], kind) for n, kind in enumerate(kinds)], names=names)

    return (
        rows.select("conv_id", "turn", "place", "role", "text", "block")
        .groupBy("block")
        .cogroup(bounds.groupBy("block"))
        .applyInArrow(
            solve,
            f"conv_id {conv.simpleString()}, turn {turns.schema['turn'].dataType.simpleString()}, place long, sub int, action string, role string, cost int, piece string",
        )
    )


def render(repaired: DataFrame) -> DataFrame:
    """(conv_id, text, cost): each repaired conversation as one string. For conversations that fit into one row."""
    pieces = F.array_sort(F.collect_list(F.struct("place", "sub", "piece")))
    return repaired.groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["piece"]), "").alias("text"), F.sum("cost").alias("cost"))


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """Every conversation repaired, as pieces that join to its rendering; see repair() for nulls, ties, repeats and empty tables."""
    return repair(load(spark, sf_dir, "conversations"))
