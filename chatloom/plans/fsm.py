"""Ordered folds per key, parallel even when one key holds most rows.

A machine folds a key's rows, in order, from an entry state to an exit state
and emits rows on the way.  It works on slices of a batch's columns, not row by
row: counters jump from trigger to trigger by binary search on running sums,
the deploy gate from deployment to deployment.  What a slice does to an entry
state that is not known yet is its ``summary``; summaries compose.

``OrderedFold`` runs a machine over every key's rows:

1. range-partition on (key, order) and sort within partitions, tag each row with
   its segment and its key as text (null keys are a key like any other), then
   checkpoint into the shared checkpoint folder so segments are pinned;
2. per partition, the slices of the first key (which may continue from the
   previous partition) are summarised and composed, and the last key's exit
   state is recorded: one row per partition, whose size is bounded by the
   machine's state space (counters) or by its number of distinct segment exits
   (the deploy gate);
3. the driver chains those rows in partition order (bounded by the partition
   count) to get each continued key's entry state;
4. every segment is replayed from its known entry state in parallel.  States are
   looked up by the segment column, so a result may be coalesced or unioned.

Work on the rows themselves happens only in the parallel summary and replay passes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatloom.session import cut_lineage

KEY_TEXT, SEGMENT, ENTRY = "_fsm_key", "_fsm_segment", "_fsm_entry"


class Machine:
    """A fold with a small finite state space: states are ints 0 .. n_states-1.

    ``load`` prepares the columns of a batch once; ``run`` folds rows
    ``start .. stop`` of it and appends what it emits to ``found``; ``emit``
    turns a batch's ``found`` into rows.
    """

    n_states: int = 1
    initial: object = 0
    #: Rows between two looks at which entry states have met.
    stride = 256

    def load(self, pdf: pd.DataFrame):  # pragma: no cover - interface
        raise NotImplementedError

    def run(self, rows, start: int, stop: int, state, found: list | None = None):  # pragma: no cover - interface
        raise NotImplementedError

    def emit(self, pdf: pd.DataFrame, found: list) -> pd.DataFrame:  # pragma: no cover - interface
        raise NotImplementedError

    # --- what a slice does to any entry state (here: the exit state of each; states that have met are run once) ---
    def summary(self, rows, start: int, stop: int):
        current = np.arange(self.n_states)
        for at in range(start, stop, self.stride):
            distinct, where = np.unique(current, return_inverse=True)
            current = np.array([self.run(rows, at, min(at + self.stride, stop), int(s)) for s in distinct])[where]
        return current.tolist()

    def compose(self, first, second):
        return [second[s] for s in first]

    def resume(self, summary, entry):
        return summary[entry]


def _runs(pdf: pd.DataFrame) -> list[tuple[int, int]]:
    """Slices of rows of one key (and segment) in a batch."""
    keys, segments = pdf[KEY_TEXT].to_numpy(), pdf[SEGMENT].to_numpy()
    cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (segments[1:] != segments[:-1])) + 1
    return list(zip([0, *cuts.tolist()], [*cuts.tolist(), len(pdf)]))


def _own_entry(machine: Machine, pdf: pd.DataFrame, row: int):
    """The state with which the key of a row starts."""
    if ENTRY not in pdf:
        return machine.initial
    given = pdf[ENTRY].iat[row]
    return machine.initial if pd.isna(given) else int(given)


def _as_state(x):
    return tuple(x) if isinstance(x, list) else x


_SUMMARY = "pid int, first_key string, first_entry string, summary string, last_key string, last_state string"


def _summaries(machine: Machine):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pid = first_key = first_entry = last_key = summary = state = None
        for pdf in batches:
            if not len(pdf):
                continue
            rows, runs = machine.load(pdf), _runs(pdf)
            start, stop = runs[0]
            if first_key is None:
                pid, first_key, first_entry = int(pdf[SEGMENT].iat[0]), pdf[KEY_TEXT].iat[0], _own_entry(machine, pdf, 0)
            if pdf[KEY_TEXT].iat[0] == first_key:
                own = machine.summary(rows, start, stop)
                summary = own if summary is None else machine.compose(summary, own)
                runs = runs[1:]
            if runs:  # of the other keys only the last one's exit is of use
                start, stop = runs[-1]
                key = pdf[KEY_TEXT].iat[start]
                state = machine.run(rows, start, stop, state if key == last_key else _own_entry(machine, pdf, start))
                last_key = key
        if first_key is not None:
            yield pd.DataFrame({"pid": [pid], "first_key": [first_key], "first_entry": [json.dumps(first_entry)], "summary": [json.dumps(summary)],
                                "last_key": [last_key], "last_state": [json.dumps(state)]})

    return run


def _replay(machine: Machine, entries: dict, out_cols: list[str] | None, key: str):
    """Emitted rows, or without ``out_cols`` the state after every segment's part of a key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cur_key = cur_segment = state = None
        for pdf in batches:
            if not len(pdf):
                continue
            rows, found, exits = machine.load(pdf), [], []
            for start, stop in _runs(pdf):
                k, segment = pdf[KEY_TEXT].iat[start], int(pdf[SEGMENT].iat[start])
                if segment != cur_segment:
                    state = entries[segment] if segment in entries else _own_entry(machine, pdf, start)
                elif k != cur_key:
                    state = _own_entry(machine, pdf, start)
                cur_key, cur_segment = k, segment
                state = machine.run(rows, start, stop, state, found)
                exits.append((start, state))
            if out_cols is None:  # a key that goes on in the next batch has a later exit there
                at = [start for start, _ in exits]
                yield pd.DataFrame({key: pdf[key].iloc[at].to_numpy(), "segment": pdf[SEGMENT].iloc[at].to_numpy(),
                                    "row": pdf["_fsm_row"].iloc[at].to_numpy(), "state": [s for _, s in exits]})
            elif found:
                yield machine.emit(pdf, found)[out_cols]

    return run


class OrderedFold:
    """A machine over each key's rows in ``order``.

    ``entry``: an int column with the state in which a row's key starts (null:
    the machine's initial state), equal in all rows of a key.
    """

    def __init__(self, df: DataFrame, key: str, order: Sequence[str], machine: Machine, cols: Sequence[str] | None = None, entry: Column | None = None):
        self.key, self.machine = key, machine
        cols, order = list(cols or df.columns), list(order)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated count, which AQE does not coalesce
        extra = [entry.cast("long").alias(ENTRY)] if entry is not None else []
        ranged = (
            df.select(*cols, *extra).repartitionByRange(n, F.col(key), *[F.col(c) for c in order]).sortWithinPartitions(key, *order)
            .withColumns({KEY_TEXT: F.to_json(F.struct(F.col(key))), SEGMENT: F.spark_partition_id()})
        )
        self.pinned = cut_lineage(ranged)
        # At most one small row per partition reaches the driver.
        found = sorted(self.pinned.mapInPandas(_summaries(machine), _SUMMARY).collect(), key=lambda r: r.pid)
        self.entries: dict = {}
        carry_key = carry_state = None
        for r in found:
            entry_state = _as_state(json.loads(r.first_entry))
            if carry_key is not None and carry_key == r.first_key:
                entry_state = self.entries[r.pid] = carry_state
            carry_key, carry_state = r.first_key, machine.resume(json.loads(r.summary), entry_state)
            if r.last_key is not None:
                carry_key, carry_state = r.last_key, _as_state(json.loads(r.last_state))

    def emitted(self, out_schema: str) -> DataFrame:
        out_cols = [f.split()[0] for f in out_schema.split(",")]
        return self.pinned.mapInPandas(_replay(self.machine, self.entries, out_cols, self.key), out_schema)

    def exits(self) -> DataFrame:
        """``(key, state)``: the int state after the last row of every key."""
        kind = self.pinned.schema[self.key].dataType.simpleString()
        rows = self.pinned.withColumn("_fsm_row", F.monotonically_increasing_id())
        ends = rows.mapInPandas(_replay(self.machine, self.entries, None, self.key), f"`{self.key}` {kind}, segment int, row long, state int")
        return ends.groupBy(self.key).agg(F.max_by("state", F.struct("segment", "row")).alias("state"))


def scan(df: DataFrame, key: str, order: Sequence[str], machine: Machine, out_schema: str,
         cols: Sequence[str] | None = None) -> DataFrame:
    """Run ``machine`` over each key's rows in ``order``; returns the emitted rows."""
    return OrderedFold(df, key, order, machine, cols).emitted(out_schema)
