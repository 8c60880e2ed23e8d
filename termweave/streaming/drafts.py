"""Drafts as a stream: the edit log folded by scope, with state across micro-batches.

Operations of a scope are applied in order of seq within a micro-batch; one that comes after a later one of an earlier
batch is counted as an error. State is dropped after idle_minutes of event time without operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from termweave.operators.context import OPS
from termweave.plans.shared import ship

OUTPUT = "context_id long, term string, draft string, checkpoints int, errors int"
STATE = "draft string, marks array<int>, done array<string>, seq long, errors int"


def apply_op(draft: str, marks: list[int], done: list[str], op: str, arg: str | None) -> tuple[str, list[int], str | None, bool]:
    """(draft, checkpoints, newly finalized term, error) after one operation."""
    if op == "insert":
        return draft + (arg or ""), marks, None, False
    if op == "delete":
        return draft[:-1], marks, None, False
    if op == "clear":
        return "", marks, None, False
    if op == "checkpoint":
        return draft, [*marks, len(draft)], None, False
    if op == "undo":
        return (draft[: marks[-1]], marks[:-1], None, False) if marks else (draft, marks, None, True)
    if op == "clear_checkpoints":
        return draft, [], None, False
    if op == "discard":
        return "", [], None, False
    if op == "finalize":
        return ("", [], None if draft in done else draft, False) if draft else (draft, marks, None, True)
    if op == "finalize_direct":
        return draft, marks, None if not arg or arg in done else arg, not arg
    assert op not in OPS
    return draft, marks, None, True


def draft_stream(log: DataFrame, idle_minutes: int = 60) -> DataFrame:
    """From a stream (context_id, seq, op, arg, ts): a row for each newly finalized term, and one of the draft as it stands.

    In the rows that only tell the draft, term is null. Rows are appended in every micro-batch that touches a scope.
    """
    ship(log.sparkSession)

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        draft, marks, done, last, errors = state.get if state.exists else ("", [], [], -1, 0)
        marks, done, rows = list(marks), list(done), []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq <= last:
                errors += 1
                continue
            last = r.seq
            draft, marks, term, bad = apply_op(draft, marks, done, r.op, r.arg)
            errors += bad
            if term is not None:
                done.append(term)
                rows.append((key[0], term, draft, len(marks), errors))
        state.update((draft, marks, done, int(last), errors))
        state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + idle_minutes * 60_000)
        rows.append((key[0], None, draft, len(marks), errors))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    timed = log.withWatermark("ts", "10 minutes").select("context_id", "seq", "op", "arg", "ts")
    return timed.groupBy("context_id").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def access_counts(log: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """From a stream (term, ts): accesses by term and window, with late rows up to the watermark."""
    return log.withWatermark("ts", late).groupBy(F.window("ts", window), "term").agg(F.count("*").alias("hits"), F.max("ts").alias("last_access"))
