"""Helpers of all operators: shared storage, sums and places in order without one big task, array expressions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see, below spark.checkpoint.dir.

    Only a local master may go without the setting (tests, a laptop): a folder
    below the warehouse is taken then.  A cluster's executors would not see it.
    """
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{top.rstrip('/')}/loom-{uuid.uuid4().hex}"


def stored(df: DataFrame, outer: bool = False, **options: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again.

    Cuts the lineage: a lost executor costs the tasks that ran on it, never the
    steps before.  The files survive every executor.  Within temporary() they
    go when it ends (outer: when the scope around it ends); otherwise the folder's
    owner clears them.
    """
    spark = df.sparkSession
    path = shared_folder(spark)
    df.write.options(**options).parquet(path)
    scopes = _SCOPES.get()[: -1 if outer else None]
    if scopes:
        scopes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file of any store that Spark reads; None if it isn't there."""
    files, p = _file(spark, path)
    if not files.exists(p):
        return None
    stream = files.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file; an error if it is there, so of two writers one wins."""
    files, p = _file(spark, path)
    stream = files.create(p, False)
    stream.write(bytearray(text.encode()))
    stream.close()


def in_short_batches(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python 1000 at a time where the session leaves that open.

    Texts are long: Arrow's default of 10,000 rows or 64 MB costs an executor of 3 GB its memory.  The setting is read
    when a result is run, so it can't be put back before; a session that has its own keeps it.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key, None) is None:
        df.sparkSession.conf.set(key, "1000")
    return df


#: The scopes of this thread's call; a list of paths each.
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what stored() writes inside.  What leaves it must be stored again, by lasting()."""
    own: list[str] = []
    token = _SCOPES.set((*_SCOPES.get(), own))
    try:
        yield
    finally:
        _SCOPES.reset(token)
        for path in own:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def lasting(df: DataFrame) -> DataFrame:
    """stored(), for a result that leaves temporary()."""
    token = _SCOPES.set(())
    try:
        return stored(df)
    finally:
        _SCOPES.reset(token)


def small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """df, marked for broadcast if it has `most` rows or fewer; beyond, joins shuffle it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have (case aside)."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name = f"_{name}"
    return name


def let(x: F.Column, f: Callable[[F.Column], F.Column]) -> F.Column:
    """f(x) with x worked out once, however often f uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _sums(numbers: F.Column, start: F.Column) -> F.Column:
    zero = F.struct(start.cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
    return F.aggregate(numbers, zero, lambda a, x: F.struct((a["at"] + x).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))["out"]


def running(numbers: F.Column, step: int = 256) -> F.Column:
    """For each number of an array<bigint> the sum of those before it.

    Arrays grow by copying, so runs of `step` are summed alone and then set behind each other.
    """

    def cut(a: F.Column) -> F.Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / step).cast("int")), lambda k: F.slice(a, k * step + 1, F.lit(step)))

    def join(runs: F.Column) -> F.Column:
        totals = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(runs, _sums(totals, F.lit(0)), _sums))

    return F.when(F.size(numbers) > 0, let(let(numbers, cut), join)).otherwise(F.array().cast("array<bigint>"))


def ranked(df: DataFrame, keys: list[str], order: list[F.Column], column: str) -> DataFrame:
    """df with each row's place (from 0) in its keys' rows by `order`, whatever the files and partitions.

    A range partitioning sorts; the places of a partition's rows begin where the
    partitions before it end.  So no task sees more than its partition, and the
    window has a row for each partition and key in it.
    """
    first = [F.col(k).asc_nulls_last() for k in keys]
    n, part, of, before = (fresh(df, c) for c in ("line", "part", "of", "before"))
    lined = stored(df.repartitionByRange(*first, *order).sortWithinPartitions(*first, *order).withColumn(n, F.monotonically_increasing_id()))
    lined = lined.withColumn(part, F.shiftright(n, 33))
    runs = lined.groupBy(*keys, part).agg(F.min(n).alias("low"), F.count("*").alias("rows"))
    upto = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1) if keys else Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(runs.select(*[F.col(k).alias(f"{of}{i}") for i, k in enumerate(keys)], F.col(part).alias(of), (F.coalesce(F.sum("rows").over(upto), F.lit(0)) - F.col("low")).alias(before)))
    on = lined[part] == starts[of]
    for i, k in enumerate(keys):
        on &= lined[k].eqNullSafe(starts[f"{of}{i}"])
    return lined.join(small(starts), on).withColumn(column, F.col(n) + F.col(before)).select(*df.columns, column)


def sums_before(rows: DataFrame, keys: list[str], order: list[str], sums: list[str], following: str | None = None) -> DataFrame:
    """rows with `<sum>_before` and `<sum>_all` for each of sums: over the rows of the same keys that come before in `order`, and over all.

    following: a column whose next value in order is added as `next`.  As in ranked(), ranges are sorted alone and what
    lies before each range comes from the ranges' totals.
    """
    n, part = fresh(rows, "line"), fresh(rows, "part")
    lined = stored(rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn(n, F.monotonically_increasing_id()))
    lined = lined.withColumn(part, F.shiftright(n, 33))
    totals = lined.groupBy(*keys, part).agg(*[F.sum(c).alias(f"t_{c}") for c in sums], *([F.min_by(following, n).alias("t_first")] if following else []))
    ranges = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy(part)
    every = Window.partitionBy(*keys)
    before = ranges.rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(*[F.col(k).alias(f"k_{i}") for i, k in enumerate(keys)], F.col(part).alias("of"), *[x for c in sums for x in (F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0)).alias(f"b_{c}"), F.sum(f"t_{c}").over(every).alias(f"a_{c}"))], *([F.lead("t_first").over(ranges).alias("b_next")] if following else []))
    ahead = stored(ahead)
    on = lined[part] == ahead["of"]
    for i, k in enumerate(keys):
        on &= lined[k].eqNullSafe(ahead[f"k_{i}"])
    within = Window.partitionBy(*keys, part).orderBy(n)
    own = within.rowsBetween(Window.unboundedPreceding, -1)
    joined = lined.join(small(ahead), on)
    out = joined.select(*rows.columns, *[x for c in sums for x in ((F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"b_{c}")).alias(f"{c}_before"), F.col(f"a_{c}").alias(f"{c}_all"))], *([F.coalesce(F.lead(following).over(within), F.col("b_next")).alias("next")] if following else []))
    return out


def quantiles(rows: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """(keys, value): the exact linear q quantile of each key's values that are not null.

    From counts for each distinct value, so no buffer holds them all.
    """
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    placed = sums_before(counts, keys, [value], ["n"])
    at = (F.col("n_all") - 1) * q
    take = lambda p: F.max(F.when((F.col("n_before") <= p) & (p < F.col("n_before") + F.col("n")), F.col(value)))
    low, high, share = take(F.floor(at)), take(F.ceil(at)), F.max(at - F.floor(at))
    return placed.groupBy(*keys).agg((low + (high - low) * share).alias(value))
