"""Counting machines shared by the streaming jobs and their batch twins."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd

from chatloom.config import DEFAULT, Thresholds
from chatloom.plans.fsm import Machine


def _running(values) -> list[int]:
    """Running sums with a leading zero: the sum of the first k values at place k."""
    return np.concatenate([[0], np.cumsum(values)]).astype(np.int64).tolist()


class TriggerMachine(Machine):
    """T5: running DPO / SFT signal counters per model line, reset on emission.

    DPO signals = negative sentiment + refusal; SFT signals = positive sentiment +
    golden (a golden positive counts twice).  DPO is checked first; a DPO emission
    resets both counters, an SFT emission resets the SFT counter only.
    State = dpo * sft_trigger + sft.  The next trigger is the nearer of the two
    places where a running sum has grown by what its counter lacks.
    """

    def __init__(self, cfg: Thresholds = DEFAULT, key: str = "model_line"):
        self.cfg = cfg
        self.key = key
        self.n_states = cfg.dpo_trigger * cfg.sft_trigger
        self.initial = 0

    def load(self, pdf: pd.DataFrame):
        s = pdf["sentiment"].astype(float).to_numpy()
        flag = lambda c: pdf[c].eq(True).to_numpy().astype(int)
        return _running((s < self.cfg.negative) + flag("is_refusal")), _running((s > self.cfg.positive) + flag("is_golden"))

    def run(self, rows, start: int, stop: int, state, found: list | None = None) -> int:
        dpo, sft = rows
        need_dpo, need_sft = self.cfg.dpo_trigger, self.cfg.sft_trigger
        d, p = divmod(state, need_sft)
        from_dpo, from_sft, end = dpo[start] - d, sft[start] - p, stop + 1
        at_dpo = bisect_left(dpo, from_dpo + need_dpo, start + 1, end)
        at_sft = bisect_left(sft, from_sft + need_sft, start + 1, end)
        while at_dpo < end or at_sft < end:
            if at_dpo <= at_sft:
                if found is not None:
                    found.append((at_dpo - 1, "dpo", dpo[at_dpo] - from_dpo))
                from_dpo, from_sft = dpo[at_dpo], sft[at_dpo]
                at_sft = bisect_left(sft, from_sft + need_sft, at_dpo + 1, end)
                at_dpo = bisect_left(dpo, from_dpo + need_dpo, at_dpo + 1, end)
            else:
                if found is not None:
                    found.append((at_sft - 1, "sft", sft[at_sft] - from_sft))
                from_sft = sft[at_sft]
                at_sft = bisect_left(sft, from_sft + need_sft, at_sft + 1, end)
        return (dpo[stop] - from_dpo) * need_sft + sft[stop] - from_sft

    def emit(self, pdf: pd.DataFrame, found: list) -> pd.DataFrame:
        at, modes, counts = zip(*found)
        out = pdf[[self.key, "timestamp", "id"]].iloc[list(at)].reset_index(drop=True)
        what = {"dpo": "dpo_signals", "sft": "positive_examples"}
        return out.assign(mode=list(modes), reason=[f"{n}_{what[m]}" for m, n in zip(modes, counts)])


TRIGGER_SCHEMA = "model_line bigint, timestamp timestamp_ntz, id string, mode string, reason string"


class IdleMachine(Machine):
    """T6 over sessions: carry the event count across idle periods until it reaches
    the minimum, then emit and reset.  A row is one completed session
    (key, session_end = last event, events)."""

    def __init__(self, min_events: int = 10, key: str = "user_id"):
        self.min_events = min_events
        self.key = key
        self.n_states = min_events
        self.initial = 0

    def load(self, pdf: pd.DataFrame):
        return _running(pdf["events"].to_numpy())

    def run(self, rows, start: int, stop: int, state, found: list | None = None) -> int:
        since = rows[start] - state
        at = bisect_left(rows, since + self.min_events, start + 1, stop + 1)
        while at <= stop:
            if found is not None:
                found.append((at - 1, rows[at] - since))
            since = rows[at]
            at = bisect_left(rows, since + self.min_events, at + 1, stop + 1)
        return rows[stop] - since

    def emit(self, pdf: pd.DataFrame, found: list) -> pd.DataFrame:
        at, counts = zip(*found)
        out = pdf[[self.key, "session_end"]].iloc[list(at)].reset_index(drop=True)
        return out.rename(columns={"session_end": "idle_from"}).assign(events=list(counts))


IDLE_SCHEMA = "user_id bigint, idle_from timestamp_ntz, events bigint"
