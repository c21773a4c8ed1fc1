"""Greedy count windows of all count rules at once, and temporal correlation of their blocks.

A window starts at the first row not yet used, takes every row within its rule's frame, and is emitted if its count
holds; then the next one starts behind it, else one row later. Rows carry their rule's number; frames and comparisons
come from it, so one set of steps serves all rules.

A group (rule and key) of a chunk or less is one run of sorted rows, handled with its neighbours by vector operations. No
task holds a larger one. If its rule has a frame, its time is cut into slots of a frame or more, and each is handled with the
rows behind it that its windows reach. Without a frame, or where a slot holds too many rows, the rows are dealt by ranges of their order, and a row's number, its window's last row and count
come from running sums within ranges and over ranges. Of its chunks of consecutive rows each tells for every row where a
walk from there leaves it; these maps are composed by pointer doubling, and each chunk is walked from where it is entered.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import json_bare
from tracewell.plans.aggregation import AggSpec
from tracewell.storage import cut, drop_cut

#: Rows of a range, and of a chunk of a group.
CHUNK = 1 << 16
#: Chunks that a slot of a large group holds by its width, and at most.
_WIDE, _MOST = 2, 4


def group_key_of(columns: list[Column]) -> Column:
    """The values as JSON texts without quotes, joined by commas, `_` where one is absent; one key for all rows without
    columns."""
    return F.concat_ws(",", *[F.coalesce(json_bare(c.cast("string")), F.lit("_")) for c in columns]) if columns else F.lit("_")


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column], most: dict[str, Column]) -> DataFrame:
    """Running sums and maxima of each group, of rows that lie in ranges `p` of the order."""
    here = Window.partitionBy(*keys, "p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    kinds = {c: (F.sum, x) for c, x in sums.items()} | {c: (F.max, x) for c, x in most.items()}
    whole = df.groupBy(*keys, "p").agg(*[f(x).alias(f"{c}_0") for c, (f, x) in kinds.items()])
    whole = whole.select(*keys, "p", *[f(f"{c}_0").over(before).alias(f"{c}_0") for c, (f, _) in kinds.items()])
    df = df.select("*", *[f(x).over(here).alias(c) for c, (f, x) in kinds.items()]).join(whole, [*keys, "p"])
    both = [F.coalesce(F.col(c) + F.col(f"{c}_0"), c, f"{c}_0").alias(c) if c in sums else F.greatest(c, f"{c}_0").alias(c) for c in kinds]
    return df.select(*[c for c in df.columns if c not in kinds and c not in {f"{k}_0" for k in kinds}], *both)

_HOLDS = {"==": np.equal, ">=": np.greater_equal, "<=": np.less_equal, ">": np.greater, "<": np.less}
_FOUND = ("win_start", "win_end", "n_rows", "win_count")


def greedy_windows(rows: DataFrame, keys: list[str], time: str, spec: AggSpec, *, value: str | None = None, ties: list[str] | None = None, unit: int = 1_000_000, chunk: int = CHUNK) -> DataFrame:
    """The windows of one rule; see rule_windows."""
    return rule_windows(rows.withColumn("rule_no", F.lit(0)), keys, time, [spec], value=value, ties=ties, unit=unit, chunk=chunk).drop("rule_no")


def rule_windows(rows: DataFrame, keys: list[str], time: str, specs: list[AggSpec], *, value: str | None = None, ties: list[str] | None = None, number: str | None = None, unit: int = 1_000_000, chunk: int = CHUNK) -> DataFrame:
    """One row per window that holds: rule_no, keys, win_start, win_end (of its rows), n_rows, win_count.

    rows: rule_no is the place of a row's rule in specs; keys must not be null; time is a long, `unit` ticks a second, rows
    without one are left out. value: the column whose distinct values the rules with a field count (absent counts as an
    empty value). ties: columns that order equal times. number: a column that numbers rows that are stored already. Without a frame, a group's frame is the whole seconds between its
    first and last row. Rows without a number are written to the shared folder while the plan is being built, and of groups beyond a
    chunk the steps between; what the result reads stays there.
    """
    order = ["t", *[f"tie_{i}" for i in range(len(ties or []))], "u"]
    names, keys = ["rule_no", *keys], [f"key_{i}" for i in range(len(keys) + 1)]
    text = F.coalesce(F.col(value).cast("string"), F.lit("")) if value else F.lit("")
    slim = rows.select(*[F.col(c).alias(k) for c, k in zip(names, keys, strict=True)], F.col(time).cast("long").alias("t"), text.alias("v"), *[F.col(c).alias(f"tie_{i}") for i, c in enumerate(ties or [])], *([F.col(number).alias("u")] if number else [])).where("t is not null")
    if not number:
        slim = cut(slim.withColumn("u", F.monotonically_increasing_id()), "window-rows")
    large = slim.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_0"), F.max("t").alias("t_1")).where(F.col("n") > chunk)
    large = cut(large, "window-groups")
    back = lambda df: df.select(*[F.col(k).alias(c) for c, k in zip(names, keys, strict=True)], *_FOUND)
    if large.head() is None:
        drop_cut(large)
        return back(_small_groups(slim, keys, order, specs, unit))
    few = _small_groups(slim.join(large.select(*keys), keys, "left_anti"), keys, order, specs, unit)
    return back(few.unionByName(_large_groups(slim.join(large.select(*keys), keys, "left_semi"), large, keys, order, specs, unit, chunk)))


def _whole(batches: Iterator[pa.RecordBatch], starts: Callable[[np.ndarray], np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The batches' rows again, so that no group lies in two of them. The first column is the row's number in its group;
    starts tells at which rows groups begin."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        begin = np.flatnonzero(starts(np.asarray(batch.column(0))))
        if len(begin) and (begin[-1] or held):
            done = [*held, batch.slice(0, begin[-1])]
            yield pa.Table.from_batches(done).combine_chunks().to_batches(max_chunksize=None)[0] if sum(x.num_rows for x in done) else batch.slice(0, 0)
            held = [batch.slice(begin[-1])]
        else:
            held.append(batch)
    if sum(x.num_rows for x in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def reached(nxt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows a walk along nxt from the starts meets; len(nxt) is the end."""
    seen = np.zeros(len(nxt) + 1, dtype=bool)
    seen[start] = True
    jump = np.append(nxt, len(nxt))
    while (jump[:-1] < len(nxt)).any():
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
    seen[jump[np.flatnonzero(seen)]] = True
    return seen[:-1]


def last_within(t: np.ndarray, z: np.ndarray, g: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The last row of its group g whose time t is z or less, for each row; groups go from rows first to rows end."""
    if not len(t):
        return np.zeros(0, dtype=np.int64)
    low = int(t.min())
    span = int(max(z.max(), t.max())) - low + 1
    if span * len(first) < 1 << 62:  # one search for all groups
        return np.searchsorted(g * span + (t - low), g * span + (z - low), side="right") - 1
    return np.concatenate([a + np.searchsorted(t[a : b + 1], z[a : b + 1], side="right") - 1 for a, b in zip(first, end, strict=True)])


def holds(specs: list[AggSpec], rule: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Whether each count is what its rule asks for."""
    number, out = np.array([s.number for s in specs])[rule], np.zeros(len(count), dtype=bool)
    for op, test in _HOLDS.items():
        of = np.array([s.op == op for s in specs])[rule]
        out[of] = test(count[of], number[of])
    return out


def count_in_windows(t: np.ndarray, z: np.ndarray, last: np.ndarray, v: np.ndarray, g: np.ndarray | None = None) -> np.ndarray:
    """Distinct values v among the rows from each one to its window's last, of rows in order of group and time: of equal
    values in a window only the first is new, and one leaves it when none follows within reach."""
    at = np.arange(len(t))
    g = np.zeros(len(t), dtype=np.int64) if g is None else g
    by = np.lexsort((at, v, g))
    parted = (np.diff(v[by]) != 0) | (np.diff(g[by]) != 0) | (z[by[:-1]] < t[by[1:]])
    new, left = np.ones(len(t), dtype=np.int64), np.ones(len(t), dtype=np.int64)
    new[by[1:]], left[by[:-1]] = parted, parted
    return np.cumsum(new)[last] - np.cumsum(left) + left


def _small_groups(slim: DataFrame, keys: list[str], order: list[str], specs: list[AggSpec], unit: int) -> DataFrame:
    numbered = slim.select((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).alias("i"), "t", "v", *keys)
    frame = np.array([-1 if s.frame is None else s.frame * unit for s in specs])
    counts = np.array([s.field is not None for s in specs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, lambda i: i == 0):
            i, t, rule = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1, 3))
            n, at = len(t), np.arange(len(t))
            if not n:
                continue
            first = np.flatnonzero(i == 0)
            g, end = np.cumsum(i == 0) - 1, np.append(first[1:], n) - 1
            t_0, t_1 = t[first][g], t[end][g]
            edge = t_0 + (t_1 - t_0) // unit * unit
            z = np.where(frame[rule] >= 0, t + frame[rule], np.where(t <= edge, edge, t_1))
            last = last_within(t, z, g, first, end)
            c = last - at + 1
            if counts[rule].any():
                v = np.asarray(batch.column(2).dictionary_encode().indices)
                c = np.where(counts[rule], count_in_windows(t, z, last, v, g), c)
            ok = holds(specs, rule, c)
            nxt = np.where(ok, last + 1, at + 1)
            keep = np.flatnonzero(reached(np.where(nxt > end[g], n, nxt), first) & ok)
            if len(keep):
                made = [pa.array(x[keep]) for x in (t, t[last], last - at + 1, c)]
                yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(keep)).columns, *made], names=[*keys, *_FOUND])

    return numbered.mapInArrow(run, _kinds(slim, keys))


def _kinds(slim: DataFrame, keys: list[str]) -> str:
    return ", ".join([f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} long" for c in _FOUND])


def _by_slots(slim: DataFrame, group: DataFrame, keys: list[str], order: list[str], specs: list[AggSpec], unit: int, chunk: int, passing: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Rows of the large groups whose slots fit, with their place i, last row R and count c; and the groups that are left.
    Tables on the way are added to passing."""
    frames = F.element_at(F.array(*[F.lit(None if s.frame is None else s.frame * unit).cast("long") for s in specs]), F.col(keys[0]).cast("int") + 1)
    width = F.greatest(F.lit(1), frames, F.ceil((F.col("t_1") - F.col("t_0") + 1) / F.col("n") * (_WIDE * chunk)))
    wide = group.select(*keys, "t_0", frames.alias("frame"), width.alias("width")).where("frame is not null")
    rows = slim.join(wide, keys).withColumn("s", F.expr("(t - t_0) div width"))
    slots = cut(rows.groupBy(*keys, "s").agg(F.count(F.lit(1)).alias("n_s")), "window-slots")
    over = slots.where(F.col("n_s") > _MOST * chunk).select(*keys).distinct()
    far = group.join(wide.select(*keys).join(over, keys, "left_anti"), keys, "left_anti")
    start = slots.select(*keys, "s", (F.sum("n_s").over(Window.partitionBy(*keys).orderBy("s")) - F.col("n_s")).alias("start"))
    # rows less than a frame behind a slot's begin are reached from the slot before
    met = F.when((F.col("s") > 0) & (F.col("t") - F.col("t_0") - F.col("s") * F.col("width") < F.col("frame")), F.array(F.col("s"), F.col("s") - 1)).otherwise(F.array("s"))
    rows = rows.join(over, keys, "left_anti").select("t", "v", *keys, *order[1:], F.col("s").alias("of"), F.explode(met).alias("s"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*keys, "s").orderBy(*order)) - 1)
    rows = rows.join(start, [*keys, "s"]).sortWithinPartitions(*keys, "s", "i").select("i", "t", "v", (F.col("of") == F.col("s")).alias("own"), "start", *keys)
    frame, counts = np.array([-1 if s.frame is None else s.frame * unit for s in specs]), np.array([s.field is not None for s in specs])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, lambda i: i == 0):
            i, t, start, rule = (np.asarray(batch.column(c)).astype(np.int64) for c in (0, 1, 4, 5))
            if not len(t):
                continue
            at, first = np.arange(len(t)), np.flatnonzero(i == 0)
            g, end = np.cumsum(i == 0) - 1, np.append(first[1:], len(t)) - 1
            z = t + frame[rule]
            last = last_within(t, z, g, first, end)
            c = last - at + 1
            if counts[rule].any():
                c = np.where(counts[rule], count_in_windows(t, z, last, np.asarray(batch.column(2).dictionary_encode().indices), g), c)
            own = np.flatnonzero(np.asarray(batch.column(3)))
            if len(own):
                made = [pa.array(x[own]) for x in (start + i, t, t[last], start + i + last - at, c)]
                yield pa.RecordBatch.from_arrays([*batch.select(keys).take(pa.array(own)).columns, *made], names=[*keys, "i", "t", "end", "R", "c"])

    kinds = ", ".join([f"{k} {slim.schema[k].dataType.simpleString()}" for k in keys] + [f"{c} long" for c in ("i", "t", "end", "R", "c")])
    passing += [slots, cut(far, "window-groups")]
    return rows.mapInArrow(run, kinds), passing[-1]


def _by_ranges(slim: DataFrame, group: DataFrame, keys: list[str], order: list[str], specs: list[AggSpec], unit: int, chunk: int, passing: list[DataFrame]) -> DataFrame:
    """The rows of _by_slots for any group, by ranges of the rows' order; tables on the way are added to passing."""
    ranges = max(1, math.ceil((group.agg(F.sum("n")).first()[0] or 0) / chunk))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col(keys[0]).cast("int") + 1)
    frame, counts = of([None if s.frame is None else s.frame * unit for s in specs], "long"), of([s.field is not None for s in specs], "boolean")

    def dealt(df: DataFrame, *by: str) -> DataFrame:
        passing.append(cut(df.repartitionByRange(ranges, *keys, *by).withColumn("p", F.spark_partition_id()), "window-ranges"))
        return passing[-1]

    # z: the time that a row's window reaches; i: its number in the group, from 0
    base = running(dealt(slim, *order), keys, order, {"i": F.lit(1).cast("long")}, {}).withColumn("i", F.col("i") - 1).drop("p", *order[1:])
    edge = F.col("t_0") + F.floor((F.col("t_1") - F.col("t_0")) / unit) * unit
    base = base.join(group, keys).withColumn("z", F.coalesce(F.col("t") + frame, F.when(F.col("t") <= edge, edge).otherwise(F.col("t_1")))).drop("n", "t_0", "t_1")
    one = F.lit(1).cast("long")
    parts = [base.where(~counts).select(*keys, "i", "t", "z", one.alias("new"), one.alias("left"))]
    if any(s.field is not None for s in specs):
        # of equal values in a window only the first is new, and one leaves it only when none follows within reach
        base = dealt(base.where(counts), "v", "i")
        near, over = Window.partitionBy(*keys, "v", "p").orderBy("i"), Window.partitionBy(*keys, "v").orderBy("p")
        ends = base.groupBy(*keys, "v", "p").agg(F.max("z").alias("z_p"), F.min("t").alias("t_n"))
        ends = ends.select(*keys, "v", "p", F.lag("z_p").over(over).alias("z_p"), F.lead("t_n").over(over).alias("t_n"))
        base = base.select("*", F.lag("z").over(near).alias("z_l"), F.lead("t").over(near).alias("t_l")).join(ends, [*keys, "v", "p"])
        parts.append(base.select(*keys, "i", "t", "z", F.coalesce(F.coalesce("z_l", "z_p") < F.col("t"), F.lit(True)).cast("long").alias("new"), F.coalesce(F.coalesce("t_l", "t_n") > F.col("z"), F.lit(True)).cast("long").alias("left")))
    base = cut(parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0], "window-rows")
    passing.append(base)
    none = F.lit(0).cast("long")
    asked = base.select(*keys, "i", F.col("z").alias("x"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("t"), none.alias("new"), none.alias("left"))
    both = base.select(*keys, "i", F.col("t").alias("x"), F.lit(0).alias("probe"), "t", "new", "left").unionByName(asked)
    both = running(dealt(both, "x", "probe", "i"), keys, ["x", "probe", "i"], {"upto": (1 - F.col("probe")).cast("long"), "news": F.col("new"), "lefts": F.col("left")}, {"last": F.col("t")})
    on = lambda probe, c: F.max(F.when(F.col("probe") == probe, F.col(c)))
    return both.groupBy(*keys, "i").agg(on(0, "t").alias("t"), on(1, "last").alias("end"), (on(1, "upto") - 1).alias("R"), (on(1, "news") - on(0, "lefts") + on(0, "left")).alias("c"))


def _large_groups(slim: DataFrame, group: DataFrame, keys: list[str], order: list[str], specs: list[AggSpec], unit: int, chunk: int) -> DataFrame:
    ranges = max(1, math.ceil((group.agg(F.sum("n")).first()[0] or 0) / chunk))
    passing: list[DataFrame] = []  # tables that the result doesn't read
    near, far = _by_slots(slim, group, keys, order, specs, unit, chunk, passing)
    full = near
    if far.head() is not None:
        full = near.unionByName(_by_ranges(slim.join(far.select(*keys), keys, "left_semi"), far, keys, order, specs, unit, chunk, passing))
    of = lambda values, kind: F.element_at(F.array(*[F.lit(x).cast(kind) for x in values]), F.col(keys[0]).cast("int") + 1)
    op, number = of([s.op for s in specs], "string"), of([s.number for s in specs], "long")
    ok = F.when(op == "==", F.col("c") == number).when(op == ">=", F.col("c") >= number).when(op == "<=", F.col("c") <= number).when(op == ">", F.col("c") > number).otherwise(F.col("c") < number)
    full = full.withColumn("ok", ok).withColumn("nxt", F.when(F.col("ok"), F.col("R") + 1).otherwise(F.col("i") + 1)).withColumn("q", F.expr(f"i div {chunk}"))
    full = cut(full, "window-rows")
    drop_cut(*passing)
    hits = full.join(_entries(full, group, keys, chunk), [*keys, "q"]).repartition(2 * ranges, *keys, "q").sortWithinPartitions(*keys, "q", "i")
    hits = hits.select("i", "nxt", "ok", "entry", *keys, F.col("t").alias("win_start"), F.col("end").alias("win_end"), (F.col("R") - F.col("i") + 1).alias("n_rows"), F.col("c").alias("win_count"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches, lambda i: i % chunk == 0):
            i, nxt, ok, entry = (np.asarray(batch.column(c)) for c in range(4))
            at, first = np.arange(len(i)), np.flatnonzero(i % chunk == 0)
            to = at + (nxt - i)
            end = np.append(first[1:], len(i))[np.cumsum(i % chunk == 0) - 1]  # behind the row's chunk
            keep = np.flatnonzero(reached(np.where(to >= end, len(i), to), first + entry[first] - i[first]) & ok)
            if len(keep):
                yield batch.select([*keys, *_FOUND]).take(pa.array(keep))

    return hits.mapInArrow(walk, _kinds(slim, keys))


def _entries(full: DataFrame, group: DataFrame, keys: list[str], chunk: int) -> DataFrame:
    """keys, q, entry: the row at which each chunk is entered, of those that are."""
    group = group.select(*keys, "n")
    most = group.agg(F.max("n")).first()[0] or 0
    start = group.select(*keys, F.lit(0).cast("long").alias("i"))
    if most > chunk:
        large = full.select(*keys, "q", "i", "nxt").join(group, keys)
        large = large.withColumn("leaves", (F.col("nxt") >= F.col("n")) | (F.expr(f"nxt div {chunk}") > F.col("q")))
        dealt = large.repartition(2 * math.ceil(most / chunk), *keys, "q").sortWithinPartitions(*keys, "q", "i").select("i", F.when(F.col("nxt") < F.col("n"), F.col("nxt")).otherwise(-1).alias("nxt"), "leaves", *keys)  # -1: the group's end

        def leave(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _whole(batches, lambda i: i % chunk == 0):
                i, nxt, leaves = (np.asarray(batch.column(c)) for c in range(3))
                at = np.arange(len(i))
                jump = np.where(leaves, at, at + nxt - i)  # a row that leaves the chunk points to itself
                while (jump[jump] != jump).any():
                    jump = jump[jump]
                yield pa.RecordBatch.from_arrays([*batch.columns[3:], batch.column(0), pa.array(nxt[jump], pa.int64())], names=[*keys, "i", "j"])

        shape = dealt.select(*keys, "i", F.col("nxt").alias("j")).schema
        met = large.where("leaves and nxt < n").select(*keys, F.col("nxt").alias("i")).unionByName(start).distinct()
        jump = cut(dealt.mapInArrow(leave, shape).where("j >= 0").join(met, [*keys, "i"], "left_semi"), "window-jumps")
        steps = 1
        while steps * chunk < most:
            start = cut(start.unionByName(start.join(jump, [*keys, "i"]).select(*keys, F.col("j").alias("i"))), "window-entries")
            jump = cut(jump.join(jump.select(*keys, F.col("i").alias("j"), F.col("j").alias("k")), [*keys, "j"]).select(*keys, "i", F.col("k").alias("j")), "window-jumps")
            steps *= 2
    return start.select(*keys, F.expr(f"i div {chunk}").alias("q"), F.col("i").alias("entry"))


def temporal(blocks: list[DataFrame], key: str, frame: int, *, ordered: bool, start: str = "win_start", unit: int = 1_000_000) -> DataFrame:
    """Blocks of the first rule for which every other rule has a block of the same key: within the frame before
    or behind, or (ordered) each at or after the one matched before and within the frame of the first. A single
    rule never fires. Times are dealt into buckets of the frame, so that a frequent key is split."""
    first = blocks[0]
    if len(blocks) < 2:
        return first.limit(0)
    span = max(1, frame * unit)
    bucket = lambda c: F.floor(F.col(c) / span)
    out = first.withColumn("prev", F.col(start))
    names = first.columns
    for other in blocks[1:]:
        near = other.select(F.col(key).alias("o_key"), F.col(start).alias("o_start")).withColumn("o_bucket", bucket("o_start"))
        if ordered:
            left = out.withColumn("b", F.explode(F.array(bucket(start), bucket(start) + 1)))
            met = left.join(near, (F.col(key) == F.col("o_key")) & (F.col("b") == F.col("o_bucket")) & (F.col("o_start") >= F.col("prev")) & (F.col("o_start") <= F.col(start) + span))
            out = met.groupBy(*names).agg(F.min("o_start").alias("prev"))
        else:
            left = out.withColumn("b", F.explode(F.array(bucket(start) - 1, bucket(start), bucket(start) + 1)))
            met = left.join(near, (F.col(key) == F.col("o_key")) & (F.col("b") == F.col("o_bucket")) & (F.abs(F.col("o_start") - F.col(start)) <= span), "left_semi")
            out = met.drop("b").distinct()
    return out.select(*names)
