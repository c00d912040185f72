"""Tables on disk kept up by key, without a merge command: only the buckets that change are written again.

A table is a folder with a manifest, CURRENT, that names for each bucket of the key's hash the folder that holds it. A
change writes new folders and then swaps the manifest in one rename, so readers see the table before or after it, never
between. Buckets are as many as the rows need at the first writing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frames import cut

#: Rows of a bucket, and files that a bucket is written to, so that a large one is not one task.
BUCKET_ROWS, WRITERS = 2_000_000, 4


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, path: str) -> dict:
    """{buckets, key, folders: bucket -> folder} of a table."""
    at, fs = _fs(spark, f"{path}/CURRENT")
    stream = fs.open(at)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _swap(spark: SparkSession, path: str, state: dict) -> None:
    """Puts a new manifest in the place of the old one by one rename."""
    fresh, fs = _fs(spark, f"{path}/CURRENT-{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    stream.write(bytearray(json.dumps(state).encode()))
    stream.close()
    jvm = spark.sparkContext._jvm
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fresh, _fs(spark, f"{path}/CURRENT")[0], options)


def with_bucket(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def _write(df: DataFrame, path: str) -> dict[str, str]:
    """bucket -> folder of the rows written; every bucket is spread over WRITERS tasks."""
    folder = f"{path}/data-{uuid.uuid4().hex}"
    df.withColumn("__w", (F.rand(7) * WRITERS).cast("int")).repartition("bucket", "__w").drop("__w").write.partitionBy("bucket").parquet(folder)
    at, fs = _fs(df.sparkSession, folder)
    return {str(x.getPath().getName())[7:]: f"{folder}/{x.getPath().getName()}" for x in fs.listStatus(at) if x.getPath().getName().startswith("bucket=")}


def write_new(df: DataFrame, path: str, key: str, buckets: int | None = None) -> None:
    """A table bucketed by a hash of its key (or of the column that groups it)."""
    n = buckets or df.count() // BUCKET_ROWS + 1
    _swap(df.sparkSession, path, {"buckets": n, "key": key, "schema": df.schema.json(), "folders": _write(with_bucket(df, key, n), path)})


def read(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """The table as its manifest stands now, or some of its buckets."""
    from pyspark.sql.types import StructType

    state = manifest(spark, path)
    schema = StructType.fromJson(json.loads(state["schema"]))
    folders = [f for b, f in state["folders"].items() if only is None or b in only]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _change(spark: SparkSession, path: str, touched: DataFrame, make) -> None:
    state = manifest(spark, path)
    # At most one row for each bucket.
    numbers = [str(r.bucket) for r in with_bucket(touched, state["key"], state["buckets"]).select("bucket").distinct().collect()]
    after = make(read(spark, path, numbers))
    folders = {b: f for b, f in state["folders"].items() if b not in numbers} | _write(with_bucket(after, state["key"], state["buckets"]), path)
    _swap(spark, path, {**state, "folders": folders})


def upsert(rows: DataFrame, path: str, key: str, group: str | None = None) -> None:
    """Puts rows in place of those with the same key, or with ``group`` in place of all rows of their groups.

    The table must have been written by the same group column (or key).
    """
    by = group or key
    _change(rows.sparkSession, path, rows, lambda old: cut(old.join(rows.select(by).distinct(), by, "left_anti").unionByName(rows)))


def delete(gone: DataFrame, path: str, key: str) -> None:
    """Deletes the rows with the keys given; a bucket that loses all its rows leaves the manifest."""
    _change(gone.sparkSession, path, gone, lambda old: cut(old.join(gone.select(key).distinct(), key, "left_anti")))
