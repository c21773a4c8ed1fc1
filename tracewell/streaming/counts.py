"""Count rules over a stream: the windows of the batch form, each emitted once the watermark has passed its frame.

A bucket of keys has as its state their records that no decided window holds: those of one frame and of the watermark's delay
at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.detect import counted
from tracewell.operators.windows import count_in_windows, holds, last_within, reached
from tracewell.plans.errors import RuleError
from tracewell.plans.leaves import Lists
from tracewell.plans.rules import Rule

_HELD = ("agg_key", "t", "file", "record_id", "v")
_STATE = "agg_key array<string>, t array<long>, file array<string>, record_id array<string>, v array<string>"
_OUT = "rule_no int, agg_key string, win_start long, win_end long, n_rows long, win_count long"
#: States a rule: keys share one by their hash, so that a micro-batch doesn't call Python for every key.
BUCKETS = 1 << 12


def count_stream(records: DataFrame, rules: list[Rule], resolve: Callable[[str], Column], lists: Lists | None = None, *, delay: str = "10 minutes", buckets: int = BUCKETS) -> DataFrame:
    """Windows of count rules over a streaming (or batch) DataFrame of records: rule_no, agg_key, win_start and win_end
    (microseconds), n_rows, win_count. Records that come later than `delay` behind the latest time seen are left out, and so
    are those without a time. Every rule needs a time frame: without one a group's frame ends with its last record. The keys
    of a rule are dealt to `buckets` states, which a stream that is started again must keep."""
    for r in rules:
        if r.agg is None or r.agg.frame is None:
            raise RuleError(f"{r.title}: a count over a stream needs a time frame")
    specs = [r.agg for r in rules]
    rows = counted(records.where("ts is not null"), rules, resolve, lists)
    bucket = F.pmod(F.xxhash64("agg_key"), F.lit(buckets)).cast("int").alias("bucket")
    rows = rows.select("rule_no", bucket, "agg_key", "t", F.coalesce("counted", F.lit("")).alias("v"), "file", "record_id", F.timestamp_micros("t").alias("at")).withWatermark("at", delay)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rule = int(key[0])
        frame = specs[rule].frame * 1_000_000
        held = pd.DataFrame(dict(zip(_HELD, state.get if state.exists else ([],) * len(_HELD), strict=True)))
        held = pd.concat([held, *(p[list(_HELD)] for p in parts)], ignore_index=True).sort_values(list(_HELD[:4]), kind="stable", na_position="first")
        t, g = held["t"].to_numpy(dtype=np.int64), pd.factorize(held["agg_key"])[0]
        z, at, n = t + frame, np.arange(len(t)), len(t)
        first = np.flatnonzero(np.diff(g, prepend=-1))
        end = np.append(first[1:], n) - 1
        last = last_within(t, z, g, first, end)
        c = count_in_windows(t, z, last, pd.factorize(held["v"])[0], g) if specs[rule].field else last - at + 1
        done = z < state.getCurrentWatermarkMs() * 1000  # later windows may still grow
        ok = holds(specs, np.full(n, rule), c) & done
        nxt = np.where(ok, last + 1, at + 1)
        met = reached(np.where(~done | (nxt > end[g]), n, nxt), first)
        made, stays = np.flatnonzero(met & ok), np.flatnonzero(met & ~done)  # a key's walk stops at the row that can't be decided yet
        if len(stays):
            since = np.full(len(first), n)
            since[g[stays]] = stays
            rest = at >= since[g]
            state.update((held["agg_key"][rest].tolist(), t[rest].tolist(), *(held[c][rest].tolist() for c in _HELD[2:])))
            state.setTimeoutTimestamp(max(int(z[stays].min()) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if len(made):
            yield pd.DataFrame({"rule_no": rule, "agg_key": held["agg_key"].to_numpy()[made], "win_start": t[made], "win_end": t[last[made]], "n_rows": last[made] - made + 1, "win_count": c[made]})

    return rows.groupBy("rule_no", "bucket").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
