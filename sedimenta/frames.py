"""Plan helpers shared by the operators: table access, lineage cuts, skew-safe ranks, group streams."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java's pattern for the characters with the Unicode property White_Space.
UNICODE_SPACE = r"\t-\r \u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same characters, for str.strip.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; one of our own only where it is unset and the master is local."""
    sc = spark.sparkContext
    known = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        known = tempfile.mkdtemp(prefix="sedimenta-")
        atexit.register(shutil.rmtree, known, True)
        spark.conf.set("spark.checkpoint.dir", known)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut by a reliable checkpoint."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame) -> DataFrame:
    """The same rows, written as a compressed table to the shared folder and read again.

    For results that several later steps read by column; the table is removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone already
        pass


def bucketed_prefix(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], values: dict[str, Column]) -> DataFrame:
    """Adds for each name the sum of its value over the rows before this one within ``keys``, without gathering a key in one task.

    ``bucket`` must rise with the order (for example the order column divided by a step). Sums run within (keys, bucket)
    and are shifted by prefix sums over the bucket totals, a table smaller by the bucket size; all names share one
    shuffle of the rows and one join.
    """
    named = [(n, f"__{n}_value", f"__{n}_before") for n in values]
    df = df.withColumn("__bucket", bucket).withColumns({v: values[n] for n, v, _ in named})
    totals = df.groupBy(*keys, "__bucket").agg(*[F.sum(v).alias(v) for _, v, _ in named])
    ahead = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), *[F.coalesce(F.sum(v).over(ahead), F.lit(0)).alias(b) for _, v, b in named])
    inner = Window.partitionBy(*keys, "__bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}")) & same
    summed = df.withColumns({n: F.coalesce(F.sum(v).over(inner), F.lit(0)) for n, v, _ in named})
    joined = summed.join(offsets, same, "left").withColumns({n: F.col(n) + F.col(b) for n, _, b in named})
    return joined.drop("__bucket", "__b", *[x for _, v, b in named for x in (v, b)], *[f"__k_{k}" for k in keys])


def bucketed_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds ``name``: the rank from 0 within ``keys``; see bucketed_prefix."""
    return bucketed_prefix(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def bucketed_sum(df: DataFrame, keys: list[str], bucket: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows before this one within ``keys``; see bucketed_prefix."""
    return bucketed_prefix(df, keys, bucket, order, {name: value})


def bucketed_lag(df: DataFrame, keys: list[str], bucket: Column, order: list[str], column: str, name: str) -> DataFrame:
    """Adds ``name``: ``column`` of the row before within ``keys`` (null for the first), without gathering a key in one task.

    Within (keys, bucket) by a window; the first row of a bucket takes the last row of the buckets before it. ``bucket``
    must rise with the order.
    """
    df = df.withColumn("__bucket", bucket)
    lasts = df.groupBy(*keys, "__bucket").agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct(*order)).alias("__last"))
    ahead = Window.partitionBy(*keys).orderBy(F.col("__bucket").asc_nulls_first())
    carried = lasts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__bucket").alias("__b"), F.lag("__last").over(ahead).alias("__carried"))
    same = F.col("__bucket").eqNullSafe(F.col("__b"))
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"__k_{k}")) & same
    inner = F.lag(F.struct(F.col(column).alias("v"))).over(Window.partitionBy(*keys, "__bucket").orderBy(*order))
    joined = df.withColumn("__own", inner).join(carried, same, "left").withColumn(name, F.coalesce("__own", "__carried")["v"])
    return joined.drop("__bucket", "__b", "__own", "__carried", *[f"__k_{k}" for k in keys])


def spread(df: DataFrame) -> DataFrame:
    """A scan of few partitions spread over all cores before a costly Python pass; a scan of many stays as it is."""
    want = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if 2 * df.rdd.getNumPartitions() <= want else df


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once for each row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def in_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], Iterable[tuple]], columns: list[str], schema: str, partitions: int | None = None) -> DataFrame:
    """Calls ``fold(key, rows)`` once per group, streaming over sorted partitions (no pandas frame per group).

    Groups must be bounded by the caller (bucketed keys), as one group is held in memory at a time.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    placed = df.select(*keys, *columns)
    placed = (placed.repartition(partitions, *keys) if partitions else placed.repartition(*keys)).sortWithinPartitions(*keys, *order)
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, rows, out = None, [], []
        for pdf in batches:
            for t in zip(*(pdf.iloc[:, i].astype(object).where(pdf.iloc[:, i].notna(), None).tolist() if pdf.iloc[:, i].dtype != object else pdf.iloc[:, i].tolist() for i in range(pdf.shape[1]))):
                if t[:k] != now:
                    if now is not None:
                        out.extend(fold(now, rows))
                    now, rows = t[:k], []
                rows.append(t[k:])
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            out.extend(fold(now, rows))
        yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, schema)


def fold_streams(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], object], step: Callable[[object, tuple], Iterable[tuple]], finish: Callable[[object], Iterable[tuple]], columns: list[str], schema: str) -> DataFrame:
    """A sequential fold for each key that holds its state only: rows stream through in order, however many a key has.

    ``step(state, row)`` changes the state and may give rows, ``finish(state)`` gives the last ones; both without the key.
    """
    names = [c.strip().split()[0] for c in schema.split(",")]
    placed = df.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys, *order)
    k = len(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, out = None, None, []
        for pdf in batches:
            for t in zip(*(pdf.iloc[:, i].astype(object).where(pdf.iloc[:, i].notna(), None).tolist() if pdf.iloc[:, i].dtype != object else pdf.iloc[:, i].tolist() for i in range(pdf.shape[1]))):
                if t[:k] != now:
                    if now is not None:
                        out.extend((*now, *r) for r in finish(state))
                    now, state = t[:k], start()
                out.extend((*now, *r) for r in step(state, t[k:]))
            if len(out) > 4096:
                yield pd.DataFrame(out, columns=names)
                out = []
        if now is not None:
            out.extend((*now, *r) for r in finish(state))
        yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, schema)
