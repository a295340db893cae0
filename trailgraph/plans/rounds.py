"""The round loop shared by the monotone algorithms and by PageRank."""

from __future__ import annotations

import time
from dataclasses import dataclass, field, replace
from typing import Protocol

from pyspark.sql import Column, DataFrame, functions as F

from trailgraph.plans.layout import EdgeLayout
from trailgraph.workspace import Table, Workspace


#: Rows that are known to be so few may be broadcast.
FEW_ROWS = 100_000
#: Ids that are known to be so few may be named in a filter.
NAMED_IDS = 1_000
#: A round is sparse if at most this part of the vertices sends.
SPARSE_SHARE = 100
#: Deltas upon the last whole state before they are merged into it.
MOST_DELTAS = 16


@dataclass(frozen=True)
class Round:
    """One finished round: the state after it, and what it took.

    ``metrics`` are those that the observer wanted.
    """

    number: int
    state: DataFrame
    changed: int
    next_changed: int | None
    nanos: int
    metrics: dict = field(default_factory=dict)


class Recent:
    """The tables of the last rounds.  Older ones are deleted: what looks at a
    finished round may still be reading the three latest."""

    KEPT = 3

    def __init__(self, workspace: Workspace):
        self.workspace = workspace
        self.tables: list[Table] = []

    def add(self, table: Table) -> Table:
        self.tables.append(table)
        while len(self.tables) > self.KEPT:
            self.workspace.drop(self.tables.pop(0))
        return table

    def keep_last(self) -> None:
        while len(self.tables) > 1:
            self.workspace.drop(self.tables.pop(0))


class RoundObserver(Protocol):
    """Sees each round that changed something; may go on reading its state until
    the next call, or ``finish``."""

    def wanted(self, number: int) -> dict[str, Column]:
        """Aggregates over the vertices ``(id, attr)`` after a round, to be taken
        by the job that writes them."""
        ...

    def __call__(self, finished: Round) -> None: ...

    def finish(self) -> None: ...


@dataclass(frozen=True)
class Outcome:
    """The last state of a loop, and whether no value could fall any further."""

    table: Table
    settled: bool


def write_round(
    workspace: Workspace,
    name: str,
    table: DataFrame,
    number: int,
    observer: RoundObserver | None,
    value: str = "value",
    **metrics: Column,
) -> tuple[Table, dict]:
    """Write a round, with what its observer wants of it taken by the same job."""
    wanted = {} if observer is None else observer.wanted(number)
    keep = None
    if wanted:
        keep, table = table.columns, table.withColumn("attr", F.col(value))
    written = workspace.write(name, table, keep=keep, **metrics, **wanted)
    return written, {key: written.observed[key] for key in wanted}


@dataclass(frozen=True)
class State:
    """Values that only fall: a whole table, and deltas with the vertices that
    fell since.  A vertex has the least of its values; ``senders`` are those that
    fell last."""

    base: Table
    senders: DataFrame
    deltas: tuple[Table, ...] = ()

    @property
    def rows(self) -> DataFrame:
        """All values, those out of date too."""
        found = self.base.df.select("id", "value")
        for delta in self.deltas:
            found = found.unionByName(delta.df)
        return found

    @property
    def values(self) -> DataFrame:
        return self.rows.groupBy("id").agg(F.min("value").alias("value")) if self.deltas else self.rows

    @property
    def tables(self) -> list[Table]:
        return [self.base, *self.deltas]


class Superseded:
    """Tables that no later round reads, but perhaps an observer of the last ones."""

    def __init__(self, workspace: Workspace):
        self.workspace = workspace
        self.waiting: list[tuple[int, Table]] = []

    def put(self, number: int, tables: list[Table]) -> None:
        self.waiting.extend((number, table) for table in tables)

    def drop(self, number: int | None = None) -> None:
        """Delete those of ``Recent.KEPT`` rounds ago, or all."""
        gone = [w for w in self.waiting if number is None or w[0] + Recent.KEPT <= number]
        for entry in gone:
            self.waiting.remove(entry)
            self.workspace.drop(entry[1])


def _whole_round(
    workspace: Workspace, layout: EdgeLayout, state: State, message: Column, number: int, observer
) -> tuple[Table, dict]:
    sent = layout.meet(state.senders).select(F.col("dst").alias("id"), message.alias("value"))
    metrics = {"changed": F.count_if(F.col("changed")), "vertices": F.count(F.lit(1))}
    joined = workspace.is_bucketed(state.base) and layout.joins_states
    if joined and not (observer is not None and observer.wanted(number)):
        merged = _met_state(state, sent)
        return workspace.write_bucketed(f"round={number}", merged, "id", layout.parts, placed=True, **metrics), {}
    value_type = state.rows.schema["value"].dataType
    merged = (
        state.rows.select("id", "value", F.col("value").alias("old"))
        .unionByName(sent.withColumn("old", F.lit(None).cast(value_type)))
        .groupBy("id")
        .agg(F.min("value").alias("value"), F.min("old").alias("old"))
        .select("id", "value", (F.col("value") < F.col("old")).alias("changed"))
    )
    return write_round(workspace, f"round={number}", merged, number, observer, **metrics)


def _met_state(state: State, sent: DataFrame) -> DataFrame:
    """``(id, value, changed)`` after ``sent``, where the whole state is bucketed:
    only messages and deltas move, and what is written is bucketed again."""
    nothing = F.lit(None).cast(sent.schema["value"].dataType)
    moved = sent.select("id", F.col("value").alias("best"), nothing.alias("fell"))
    for delta in state.deltas:
        moved = moved.unionByName(delta.df.select("id", nothing.alias("best"), F.col("value").alias("fell")))
    least = moved.groupBy("id").agg(F.min("best").alias("best"), F.min("fell").alias("fell"))
    old = F.least("value", "fell")
    return (
        state.base.df.select("id", "value")
        .join(least.hint("shuffle_hash"), "id", "left")
        .select("id", F.least(old, "best").alias("value"), F.coalesce(F.col("best") < old, F.lit(False)).alias("changed"))
    )


def _sparse_round(
    workspace: Workspace, layout: EdgeLayout, state: State, message: Column, number: int, senders: int
) -> Table:
    """The delta of a round with ``senders`` senders, few enough to be broadcast."""
    best = (
        layout.meet_few(state.senders, _named(state.senders, senders))
        .select(F.col("dst").alias("id"), message.alias("value"))
        .groupBy("id")
        .agg(F.min("value").alias("value"))
    )
    messages = workspace.write(f"messages={number}", best, rows=F.count(F.lit(1)))
    rows = messages.observed["rows"]
    receivers = messages.df.select("id")
    ids = _named(receivers, rows)
    if ids is not None:
        known = state.rows.filter(F.col("id").isin(ids))
    else:
        known = state.rows.join(F.broadcast(receivers) if rows <= FEW_ROWS else receivers, "id", "left_semi")
    nothing = F.lit(None).cast(known.schema["value"].dataType)
    fallen = (
        known.select("id", "value", F.col("value").alias("old"))
        .unionByName(messages.df.withColumn("old", nothing))
        .groupBy("id")
        .agg(F.min("value").alias("value"), F.min("old").alias("old"))
        .filter("value < old")
        .select("id", "value")
    )
    delta = workspace.write(f"delta={number}", fallen, changed=F.count(F.lit(1)))
    workspace.drop(messages)
    return delta


def _named(rows: DataFrame, count: int) -> list[int] | None:
    """The ids of ``rows``, if ``count`` says that they are few enough to be named."""
    return [row["id"] for row in rows.select("id").collect()] if count <= NAMED_IDS else None


def relax(
    workspace: Workspace,
    layout: EdgeLayout,
    initial: DataFrame,
    message: Column,
    max_rounds: int | None = None,
    on_round: RoundObserver | None = None,
) -> Outcome:
    """Lower the values of ``initial (id, value, changed)`` until none can fall.

    Each round, the vertices changed by the last one send ``message`` (built
    from ``value`` and the edge columns) along their out-edges, and every vertex
    keeps the minimum.  Only changed vertices need to send, because what the
    others would send has been applied already.  State and messages are merged
    by one aggregation: one job and one vertex-sized shuffle per round.  A state
    of many vertices is bucketed like the edges instead, so that a round moves
    its messages alone, unless a vertex has no id or an observer has metrics.

    A round with few senders is sparse: they are broadcast to the edges, what
    they send meets the values of its receivers alone, and the vertices that
    fall are written as a delta.  So it shuffles and writes no more than
    it sends, and reads only the buckets of its senders and receivers where
    those can be named.  Rounds with metrics of an observer are written whole.

    ``on_round`` sees each round that changed something, once it is known how
    many vertices the following round changes (after a capped last round that
    takes one more pass, whose result is dropped).
    """
    base = Table(initial, "")
    if layout.joins_states:
        base = workspace.write_bucketed("start", initial, "id", layout.parts)
    state = State(base, base.df.filter("changed").select("id", "value"))
    superseded = Superseded(workspace)
    vertices = number = 0
    pending: Round | None = None
    settled = False
    while True:
        capped = max_rounds is not None and number >= max_rounds
        if capped and on_round is None:
            break
        started = time.perf_counter_ns()
        wanted = on_round is not None and bool(on_round.wanted(number))
        sparse = (
            pending is not None and not wanted
            and pending.changed <= min(FEW_ROWS, vertices // SPARSE_SHARE)
        )
        metrics: dict = {}
        if sparse:
            if len(state.deltas) >= MOST_DELTAS or not workspace.is_bucketed(state.base):
                base = workspace.write_bucketed(f"state={number}", state.values, "id", layout.parts)
                superseded.put(number, state.tables)
                state = State(base, state.senders)
            following = _sparse_round(workspace, layout, state, message, number, pending.changed)
        else:
            following, metrics = _whole_round(workspace, layout, state, message, number, on_round)
            vertices = following.observed["vertices"]
        changed = following.observed["changed"]
        if pending is not None and on_round is not None:
            on_round(replace(pending, next_changed=changed))
        if capped or changed == 0:
            settled = changed == 0
            workspace.drop(following)
            break
        if sparse:
            state = State(state.base, following.df, (*state.deltas, following))
        else:
            superseded.put(number, state.tables)
            state = State(following, following.df.filter("changed").select("id", "value"))
        superseded.drop(number)
        pending = Round(
            number, state.values, changed, None, time.perf_counter_ns() - started, metrics
        )
        number += 1
    if on_round is not None:
        on_round.finish()
    last = state.base
    if workspace.is_bucketed(last) and not state.deltas:
        last = workspace.plain(last)
    elif state.deltas:
        last = workspace.write("last", state.values)
        superseded.put(number, state.tables)
    superseded.drop()
    return Outcome(last, settled)
