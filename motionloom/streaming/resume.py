"""Requests that still need an answer: what failed or was lost comes again, what is answered does not.

Each key (say model, prompt and segment) has a state: asked, failed or done, and since when.  A stream of requests
and answers updates it; a request passes if its key was never asked, has failed, or was asked longer than
``patience`` ago without an answer.  The state is the stream's own, so it survives restarts from the
checkpoint.  Rows are taken in order of their times inside a batch; one that comes ``late`` behind the newest
is dropped, as Spark does with late rows.  A key without rows for ``keep`` is forgotten by its timer; its next
request passes.

Keys are dealt to buckets by a hash, and a bucket's keys are looked after together: the stream calls Python once a bucket and batch, not once a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ASKED, FAILED, DONE = range(3)
#: Keys as text that no two keys share, and back.
_TEXT = {"ignoreNullFields": "false", "timeZone": "UTC", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_ANSWERS = np.array([None, False, True], dtype=object)
_STATE = "dealt int, names array<string>, what array<int>, since array<long>, until array<long>"


def decide(state: tuple[int, int] | None, rows: list[tuple[int, bool | None]], patience: int) -> tuple[list[bool], tuple[int, int] | None]:
    """Which rows (microseconds, and true or false for answers, null for requests) pass, and the state after them."""
    passed = []
    for at, ok in rows:
        go = False
        if ok is None:
            go = state is None or state[0] == FAILED or state[0] == ASKED and at - state[1] > patience
            if go:
                state = ASKED, at
        elif ok:
            state = DONE, at
        elif state is None or state[0] != DONE:  # a late failure does not undo an answer
            state = FAILED, at
        passed.append(go)
    return passed, state


def stream_resume(
    rows: DataFrame, keys: list[str], ok: str, tie: str, patience: timedelta = timedelta(hours=6), keep: timedelta = timedelta(days=365), late: str = "30 days", buckets: int = 4096
) -> DataFrame:
    """The requests that pass: keys, ``tie`` and ts.

    ``rows`` has ts, the keys, ``tie`` (orders rows of one time) and ``ok``: null for a request, true or false for an answer.
    A bucket's state is written again when one of its keys has rows: choose ``buckets`` so that each has some hundred
    keys.  A checkpoint keeps the number it began with; another one is an error.
    """
    kinds = dict(rows.dtypes)
    wait, held = patience // timedelta(microseconds=1), keep // timedelta(milliseconds=1)
    out = ["__loom_key", tie, "__loom_no_tie", "__loom_us"]

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        dealt, *lists = state.get if state.exists else (buckets, [], [], [], [])
        if dealt != buckets:
            raise ValueError(f"this checkpoint has {dealt} buckets of keys, not {buckets}")
        known = {name: values for name, *values in zip(*lists, strict=True)}
        now = state.getCurrentWatermarkMs()
        if not state.hasTimedOut:
            pdf = pd.concat(list(batches), ignore_index=True)
            codes, names = pd.factorize(pdf["__loom_key"])
            ties = pdf[tie].to_numpy() if pdf[tie].dtype.kind in "iufM" else pd.factorize(pdf[tie], sort=True)[0]
            order = np.lexsort((ties, pdf["__loom_no_tie"].to_numpy(), pdf["__loom_us"].to_numpy(), codes))
            pdf, codes = pdf.iloc[order], codes[order]
            timed = list(zip(pdf["__loom_us"].tolist(), _ANSWERS[pdf["__loom_answer"].to_numpy()].tolist(), strict=True))
            passed = []
            for a, b in pairwise([0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), len(codes)]):
                name = names[codes[a]]
                before = known.get(name)
                go, (what, since) = decide(before and (before[0], before[1]), timed[a:b], wait)
                passed += go
                known[name] = [what, since, max(since // 1000, now) + held]
            if any(passed):
                yield pdf.loc[passed, out]
        known = {name: values for name, values in known.items() if values[2] >= now}
        if not known:
            state.remove()
            return
        what, since, until = map(list, zip(*known.values(), strict=True))
        state.update((buckets, list(known), what, since, until))
        state.setTimeoutTimestamp(min(until))

    # A missing integer would turn its column, in pandas, into floats: it is a mark beside the column.
    whole = kinds[tie] in ("tinyint", "smallint", "int", "bigint")
    plain = [(F.col(c) + F.lit(0)).cast(kinds[c]).alias(c) if kinds[c] in ("float", "double") else F.col(c) for c in keys]  # -0.0 and 0.0 are one key
    name = F.to_json(F.struct(*plain), _TEXT)
    answer = F.when(F.col(ok).isNull(), 0).when(F.col(ok), 2).otherwise(1)
    told = rows.withWatermark("ts", late).select(
        "ts", F.unix_micros("ts").alias("__loom_us"), name.alias("__loom_key"), F.coalesce(tie, F.lit(0).cast(kinds[tie])).alias(tie) if whole else tie, F.col(tie).isNull().alias("__loom_no_tie"), answer.alias("__loom_answer")
    )
    dealt = told.withColumn("__loom_bucket", F.pmod(F.xxhash64("__loom_key"), F.lit(buckets)).cast("int")).groupBy("__loom_bucket")
    kept = dealt.applyInPandasWithState(step, f"__loom_key string, `{tie}` {kinds[tie]}, __loom_no_tie boolean, __loom_us long", _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    again = F.from_json("__loom_key", ", ".join(f"`{c}` {kinds[c]}" for c in keys), _TEXT)
    return kept.withColumn("__loom_keys", again).select("__loom_keys.*", F.when(~F.col("__loom_no_tie"), F.col(tie)).alias(tie), F.timestamp_micros("__loom_us").cast(kinds["ts"]).alias("ts"))
