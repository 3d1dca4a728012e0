"""Recursions along series of any length: segmented scans over ranges.

Rows are sorted over ranges of (keys, order), so one series may fill many partitions.
A partition reduces what it has to one state: a sum, a last value, or the affine map
(a, b) that carries a state across it.  Only the series that a partition begins with
can go on from the partition before, so a partition's rows need one state from
outside.  The driver composes one row per partition; the states are joined back and
finish each partition's first series.  One shuffle whatever the number of scans.

scan() takes any number of these at once, each named by its result's column:

* carry: the latest value so far that isn't null, of any type;
* lag: the value of the row before;
* sums: the running sum with the row's own, null as 0 (long or double);
* affine: y[i] = a[i] * y[i - 1] + b[i] behind y[-1] = start, a double; start is that
  of the series' first row.  Where a or b is null the state stays as it is;
* rival: the greatest value of the rows before that belong to another group than the
  row's own, of (value, group).  Its state is the two greatest values of different
  groups, which merge as sums do, so there may be any number of groups.

Ties of `order` come in any order, so it should name rows.  Null keys are a series.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import fresh, small, stored

Map = tuple[np.ndarray, np.ndarray, np.ndarray]


def then(first: tuple, second: Map) -> Map:
    """The map `second` behind `first`; maps (a, b, fresh), of which fresh ones forget what came before."""
    a, b, new = second
    with np.errstate(invalid="ignore", over="ignore"):
        return np.where(new, a, a * first[0]), np.where(new, b, a * first[1] + b), new | first[2]


def compose(a: np.ndarray, b: np.ndarray, new: np.ndarray) -> Map:
    """For each place the map of all up to it; runs of about the root of their number are composed side by side."""
    n = len(a)
    if n < 2:
        return a, b, new
    width = int(np.ceil(np.sqrt(n)))
    rows = -(-n // width)
    fill = lambda x, v: np.concatenate([x, np.full(rows * width - n, v, x.dtype)]).reshape(rows, width)
    out = fill(a, 1.0), fill(b, 0.0), fill(new, False)
    for j in range(1, width):
        for part, value in zip(out, then(tuple(x[:, j - 1] for x in out), tuple(x[:, j] for x in out)), strict=True):
            part[:, j] = value
    before = [np.ones(rows), np.zeros(rows), np.zeros(rows, bool)]
    for k in range(1, rows):
        for part, value in zip(before, then(tuple(x[k - 1] for x in before), tuple(x[k - 1, -1] for x in out)), strict=True):
            part[k] = value
    done = then(tuple(x[:, None] for x in before), out)
    return tuple(x.ravel()[:n] for x in done)


Top = tuple[Any, Any, Any, Any]


def leaders(a: Top, b: Top) -> Top:
    """The greatest value with its group, and the greatest of another group, of two such states."""
    have = sorted(((v, g) for s in (a, b) for v, g in (s[:2], s[2:]) if v is not None), key=lambda x: x[0], reverse=True)
    if not have:
        return (None,) * 4
    other = next((x for x in have if x[1] != have[0][1]), (None, None))
    return (*have[0], *other)


TOP = ("best", "best of", "next", "next of")


def _differ(table: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Whether each row but the first has other keys than the row before."""
    out = np.zeros(table.num_rows - 1, bool)
    for k in keys:
        c = table.column(k)
        x, y = c.slice(0, len(c) - 1), c.slice(1)
        one = pc.xor(pc.is_null(x), pc.is_null(y))
        out |= pc.or_(one, pc.fill_null(pc.not_equal(x, y), False)).to_numpy(zero_copy_only=False)
    return out


def _local(keys: list[str], at: dict[str, str], carry: dict[str, str], lag: dict[str, str], sums: dict[str, str], affine: dict[str, tuple[str, str]], rival: dict[str, tuple[str, str]], kinds: pa.Schema):
    """Scans within a partition; at: names of the columns for row number and `in the partition's first series`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, head, last = 0, True, None
        state: dict[str, Any] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            joined = batch if last is None else pa.Table.from_batches([last, batch]).combine_chunks().to_batches()[0]
            new = _differ(joined, keys) if last is not None else np.concatenate([[False], _differ(batch, keys)])
            heads = head & ~np.logical_or.accumulate(new)
            start = np.maximum.accumulate(np.where(new, np.arange(n), -1))  # -1: the series goes on from the last batch
            made = {at["row"]: pa.array(np.arange(done, done + n)), at["head"]: pa.array(heads)}
            for out, c in carry.items():
                column = batch.column(c)
                known = np.maximum.accumulate(np.where(column.is_valid().to_numpy(zero_copy_only=False), np.arange(n), -1))
                held = state.get(out, pa.nulls(1, column.type))
                every = pa.concat_arrays([held, column])
                made[out] = every.take(pa.array(known + 1, mask=(known < start) | ((known < 0) & (start >= 0))))
                state[out] = made[out].slice(n - 1)
            for out, c in lag.items():
                column = batch.column(c)
                every = pa.concat_arrays([state.get(out, pa.nulls(1, column.type)), column])
                made[out] = every.take(pa.array(np.arange(n), mask=new))
                state[out] = column.slice(n - 1)
            for out, c in sums.items():
                x = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False)
                if x.dtype.kind == "f":
                    total = compose(np.ones(n), x, new)
                    _, y, _ = then((1.0, state.get(out, 0.0), False), total)
                else:
                    y = np.cumsum(x)
                    y = y - np.where(start > 0, y[start - 1], 0) + np.where(start < 0, state.get(out, 0), 0)
                made[out], state[out] = pa.array(y), y[-1]
            for out, (a, b) in affine.items():
                stays = pc.or_(batch.column(a).is_null(), batch.column(b).is_null()).to_numpy(zero_copy_only=False)
                number = lambda c: batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False)
                x, y = np.where(stays, 1.0, number(a)), np.where(stays, 0.0, number(b))
                y = np.where(new, x * batch.column(f"{out} start").fill_null(0.0).to_numpy(zero_copy_only=False) + y, y)
                x = np.where(new, 0.0, x)
                whole = then(state.get(out, (1.0, 0.0, False)), compose(x, y, new))
                state[out] = tuple(p[-1] for p in whole)
                made[f"{out} a"], made[out] = pa.array(whole[0]), pa.array(whole[1])
            for out, (v, g) in rival.items():
                top, reach, tops = state.get(out, (None,) * 4), [], []
                for first, value, group in zip(new.tolist(), batch.column(v).to_pylist(), batch.column(g).to_pylist(), strict=True):
                    top = (None,) * 4 if first else top
                    reach.append(top[2] if top[1] == group else top[0])
                    if value is not None and (top[0] is None or value > top[0]):
                        top = (value, group, *(top[2:] if top[1] == group else top[:2]))
                    elif value is not None and group != top[1] and (top[2] is None or value > top[2]):
                        top = (*top[:2], value, group)
                    tops.append(top)
                state[out] = top
                made[out] = pa.array(reach, batch.column(v).type)
                made |= {f"{out} {c}": pa.array([t[i] for t in tops], batch.column(g if i % 2 else v).type) for i, c in enumerate(TOP)}
            done, head, last = done + n, bool(heads[-1]), batch.slice(n - 1)
            every = {**dict(zip(batch.schema.names, batch.columns, strict=True)), **made}
            yield pa.RecordBatch.from_arrays([every[f.name].cast(f.type) if every[f.name].type != f.type else every[f.name] for f in kinds], schema=kinds)

    return run


def scan(rows: DataFrame, keys: list[str], order: list[Column | str], *, carry: dict[str, Column] | None = None, lag: dict[str, Column] | None = None, sums: dict[str, Column] | None = None, affine: dict[str, tuple[Column, Column, Column]] | None = None, rival: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """rows with a column for each scan along each series (see above)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    carry, lag, sums, affine, rival = (x or {} for x in (carry, lag, sums, affine, rival))
    asked = {**{f"{k} in": c for k, c in (carry | lag | sums).items()}, **{f"{k} {n}": c.cast("double") for k, v in affine.items() for n, c in zip(("by", "plus", "start"), v, strict=True)}}
    asked |= {f"{k} {n}": c for k, v in rival.items() for n, c in zip(("value", "group"), v, strict=True)}
    names = [fresh(rows, k) for k in ("row", "head", "part")]
    at = dict(zip(("row", "head", "part"), names, strict=True))
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ready = rows.withColumns(asked)
    extra = [T.StructField(at["row"], T.LongType()), T.StructField(at["head"], T.BooleanType())]
    extra += [T.StructField(k, ready.schema[f"{k} in"].dataType if k not in sums or ready.schema[f"{k} in"].dataType == T.DoubleType() else T.LongType()) for k in carry | lag | sums]
    extra += [T.StructField(c, T.DoubleType()) for k in affine for c in (f"{k} a", k)]
    extra += [T.StructField(c, ready.schema[f"{k} {t}"].dataType) for k in rival for c, t in ((k, "value"), *zip((f"{k} {x}" for x in TOP), ("value", "group") * 2, strict=True))]
    kind = T.StructType([*ready.schema.fields, *extra])
    named = lambda d: {k: f"{k} in" for k in d}
    local = _local(keys, at, named(carry), named(lag), named(sums), {k: (f"{k} by", f"{k} plus") for k in affine}, {k: (f"{k} value", f"{k} group") for k in rival}, to_arrow_schema(kind))
    sorted_ = ready.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys], *order).sortWithinPartitions(*[F.col(k).asc_nulls_first() for k in keys], *order)
    lined = stored(sorted_.mapInArrow(local, kind).withColumn(at["part"], F.spark_partition_id()))

    ends = [*keys, *[f"{k} start" for k in affine]], [*keys, at["head"], *[f"{k} in" for k in lag], *carry, *sums, *[c for k in affine for c in (f"{k} a", k)], *[f"{k} {c}" for k in rival for c in TOP]]
    pick = lambda f, cs: f(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cs)]), at["row"])
    edges = lined.groupBy(at["part"]).agg(pick(F.min_by, ends[0]).alias("first"), pick(F.max_by, ends[1]).alias("last")).orderBy(at["part"]).collect()
    results = [*carry, *lag, *sums, *affine]
    states, before, out = [], None, {}
    for e in edges:  # one row for each range
        first, last = dict(zip(ends[0], e["first"], strict=True)), dict(zip(ends[1], e["last"], strict=True))
        on = before is not None and all(before[k] == first[k] for k in keys)
        single = last[at["head"]]
        into = {k: out[k] if on else (type(last[k])(0) if k in sums else (first[f"{k} start"] or 0.0) if k in affine else None) for k in [*carry, *lag, *sums, *affine]}
        into |= {k: out[k] if on else (None,) * 4 for k in rival}
        states.append((e[at["part"]], *[into[k] for k in results], *[x for k in rival for x in into[k]]))
        out = {k: into[k] if last[k] is None and single else last[k] for k in carry} | {k: last[f"{k} in"] for k in lag} | {k: last[k] + (into[k] if single else 0) for k in sums}
        out |= {k: last[k] + last[f"{k} a"] * into[k] if single else last[k] for k in affine}
        out |= {k: leaders(into[k] if single else (None,) * 4, tuple(last[f"{k} {c}"] for c in TOP)) for k in rival}
        before = {k: last[k] for k in keys}
    # Results hide input columns of the same name.
    kept = [c for c in rows.columns if c not in results and c not in rival]
    state = T.StructType([T.StructField("of", T.IntegerType()), *[T.StructField(f"{k} into", kind[k].dataType) for k in results], *[T.StructField(f"{k} into {c}", kind[f"{k} {c}"].dataType) for k in rival for c in TOP]])
    known = small(rows.sparkSession.createDataFrame(states, state))
    col = lambda c: F.col(f"`{c}`")
    head = col(at["head"])
    last_ = {k: F.coalesce(col(k), F.when(head, col(f"{k} into"))) for k in carry}
    last_ |= {k: F.when(col(at["row"]) == 0, col(f"{k} into")).otherwise(col(k)) for k in lag}
    last_ |= {k: F.when(head, col(k) + col(f"{k} into")).otherwise(col(k)) for k in sums}
    last_ |= {k: F.when(head, col(k) + col(f"{k} a") * col(f"{k} into")).otherwise(col(k)) for k in affine}
    outside = lambda k: F.when(col(f"{k} into best of").eqNullSafe(col(f"{k} group")), col(f"{k} into next")).otherwise(col(f"{k} into best"))
    last_ |= {k: F.greatest(col(k), F.when(head, outside(k))) for k in rival}
    return lined.join(known, lined[at["part"]] == known["of"]).select(*[col(c) for c in kept], *[c.alias(k) for k, c in last_.items()])


def exponential_mean(rows: DataFrame, keys: list[str], order: list[Column | str], value: str, share: float, column: str = "mean") -> DataFrame:
    """rows with m[i] = m[i - 1] + share * (x[i] - m[i - 1]), from the first value on; a null value leaves it."""
    x = F.col(value).cast("double")
    return scan(rows, keys, order, affine={column: (F.when(x.isNotNull(), F.lit(1 - share)), x * share, x)})


def relaxed(rows: DataFrame, keys: list[str], order: list[Column | str], target: str, seconds: str, rate: float, start: float | None = None, column: str = "state") -> DataFrame:
    """rows with a state that relaxes to `target`: s += (1 - exp(-rate * dt)) * (target - s), dt since the row before.

    The thermal lag (rate 1 / time constant) and the low-pass (rate 2 pi bandwidth) are both this.  start: state before
    the first row, which then has dt 0; without it the state begins at the first target.
    """
    before = fresh(rows, "before")
    timed = scan(rows, keys, order, lag={before: F.col(seconds).cast("double")})
    keep = F.exp(-rate * F.greatest(F.coalesce(F.col(seconds).cast("double") - F.col(before), F.lit(0.0)), F.lit(0.0)))
    x = F.col(target).cast("double")
    return scan(timed, keys, order, affine={column: (keep, (1 - keep) * x, x if start is None else F.lit(start))}).drop(before)


def correlated(rows: DataFrame, keys: list[str], order: list[Column | str], noise: str, seconds: str, sigma: float, tau: float, column: str = "noise") -> DataFrame:
    """rows with an Ornstein-Uhlenbeck state driven by unit noise: s = k s + sigma sqrt(1 - k k) noise, k = exp(-dt / tau), from 0 on."""
    before = fresh(rows, "before")
    timed = scan(rows, keys, order, lag={before: F.col(seconds).cast("double")})
    keep = F.exp(-F.greatest(F.coalesce(F.col(seconds).cast("double") - F.col(before), F.lit(0.0)), F.lit(0.0)) / tau)
    return scan(timed, keys, order, affine={column: (keep, sigma * F.sqrt(1 - keep * keep) * F.col(noise), F.lit(0.0))}).drop(before)


def latches(triggers: DataFrame, keys: list[str], at: str, id: str, hold: float) -> DataFrame:  # noqa: A002
    """The triggers that latch, with `until`: a series' first one, and each first one at or after the last one's until.

    A trigger's successor is the first one at or after its own until, found by one reversed scan of triggers and
    untils.  The chain from each series' first trigger is then followed in steps of doubling length, so the number of
    joins grows with the logarithm of the number of latches, whatever the length of a series.  id names a trigger
    within its series; triggers at the same time count in order of id.
    """
    own = stored(triggers.select(*keys, id, F.col(at).cast("double").alias("_at")))
    mine = own.select(*keys, F.col("_at").alias("_t"), F.lit(0).alias("_ask"), F.col(id).alias("_own"))
    asks = own.select(*keys, (F.col("_at") + hold).alias("_t"), F.lit(1).alias("_ask"), F.col(id).alias("_own"))
    # Backwards a trigger comes before a question of its own time, and of triggers at one time the least id last.
    found = scan(asks.unionAll(mine), keys, [F.col("_t").desc(), "_ask", F.col("_own").desc()], carry={"_next": F.when(F.col("_ask") == 0, F.col("_own"))})
    ks = [f"_k{i}" for i in range(len(keys))]
    other = lambda df, **names: df.select(*[F.col(k).alias(f"{k}r") for k in ks], *[F.col(c).alias(n) for c, n in names.items()])
    same = lambda: [F.col(k).eqNullSafe(F.col(f"{k}r")) for k in ks]
    named = [F.col(c).alias(k) for c, k in zip(keys, ks, strict=True)]
    jump = stored(found.filter("_ask = 1 and _next is not null").select(*named, F.col("_own").alias("_id"), "_next"))
    seen = stored(own.groupBy(*named).agg(F.min_by(id, F.struct("_at", id)).alias("_id")))
    while True:
        new = stored(jump.join(other(seen, _id="_from"), [*same(), F.col("_id") == F.col("_from")]).select(*ks, F.col("_next").alias("_id")))
        if new.isEmpty():
            break
        seen = stored(seen.unionAll(new))
        jump = stored(jump.join(other(jump, _id="_mid", _next="_far"), [*same(), F.col("_next") == F.col("_mid")]).select(*ks, "_id", F.col("_far").alias("_next")))
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(keys, ks, strict=True)]
    return triggers.join(seen, [*on, F.col(id) == F.col("_id")], "left_semi").withColumn("until", F.col(at).cast("double") + hold)
