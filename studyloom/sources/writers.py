"""Sinks over Parquet tables: append, scoped replacement, cascade deletion, coalescing update, insert if absent.

A table is a folder. Rewrites go to a new folder beside it and are swapped in by the caller's catalog or by :func:`replace`,
so a lost job leaves the old table whole."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, partition: str | None = None) -> None:
    writer = rows.write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs
    jpath = hadoop.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def replace(rows: DataFrame, path: str) -> None:
    """Write the new table as a version of its own beside the old one, then point to it. The pointer is renamed over the old
    one in one step, so a reader finds the old table or the new one, and one that is reading goes on; :func:`vacuum` removes
    what is not pointed to any more."""
    spark, version = rows.sparkSession, f"version-{uuid.uuid4().hex}"
    rows.write.parquet(f"{path}/{version}")
    fresh, fs = _files(spark, f"{path}/_pointer-{version}")
    out = fs.create(fresh)
    out.write(bytearray(version.encode()))
    out.close()
    kind = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(fresh), fs.makeQualified(_files(spark, f"{path}/_pointer")[0]), options)


def _version(spark: SparkSession, path: str) -> str:
    jpath, fs = _files(spark, f"{path}/_pointer")
    held = fs.open(jpath)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(held, "UTF-8")
    finally:
        held.close()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The table that :func:`replace` wrote last."""
    return spark.read.parquet(f"{path}/{_version(spark, path)}")


def vacuum(spark: SparkSession, path: str) -> int:
    """Remove the versions that are not current; how many went. Only where nobody reads them any more."""
    held, (folder, fs) = _version(spark, path), _files(spark, path)
    old = [f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("version-") and f.getPath().getName() != held]
    for jpath in old:
        fs.delete(jpath, True)
    return len(old)


def replace_scope(rows: DataFrame, path: str, scope: str) -> None:
    """Replace only the partitions of ``scope`` that the rows have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def delete_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return table.join(keys.select(*on).distinct(), on, "left_anti")


def delete_cascade(tables: dict[str, DataFrame], root: str, keys: DataFrame, children: list[tuple[str, str, str]]) -> dict[str, DataFrame]:
    """Delete keys (column id) of ``root`` and, in the order given, the rows of each child (table, column, parent) whose parent
    rows go."""
    gone = {root: keys.select("id").distinct()}
    out = dict(tables)
    out[root] = delete_keys(tables[root], gone[root], ["id"])
    for name, column, parent in children:
        lost = tables[name].join(gone[parent].withColumnRenamed("id", column), column, "left_semi")
        gone[name] = lost.select("id").distinct()
        out[name] = delete_keys(tables[name], gone[parent].withColumnRenamed("id", column), [column])
    return out


def update_coalesce(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Set each column to the change's value where that is not null."""
    both = [c for c in table.columns if c in changes.columns and c != key]
    new = changes.select(key, *(F.col(c).alias(f"new_{c}") for c in both))
    return table.join(new, key, "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in both else F.col(c) for c in table.columns))


def insert_if_absent(table: DataFrame, rows: DataFrame, on: list[str], active: str = "true") -> DataFrame:
    """Append the rows whose key no active row has; one row a key."""
    held = table.where(active).select(*on).distinct()
    fresh = rows.dropDuplicates(on).join(held, on, "left_anti")
    return table.unionByName(fresh.select(*table.columns))


def changed_roles(chunks: DataFrame, role: str, computed: str) -> DataFrame:
    """Only the rows whose role is another now."""
    return chunks.where(~F.col(role).eqNullSafe(F.col(computed))).withColumn(role, F.col(computed)).drop(computed)


def with_keys(rows: DataFrame, *parts: str, name: str = "id") -> DataFrame:
    """A stable key from the row's own columns, so that a repeated job gives the same keys."""
    return rows.withColumn(name, F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(p).cast("string"), F.lit("\u0000")) for p in parts)), 256))


def plan_rows(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Plans (plan_id, days array<struct<objective, activities array<string>>>) as day and activity rows."""
    days = plans.select("plan_id", F.posexplode("days").alias("session_index", "day"))
    acts = days.select("plan_id", "session_index", F.posexplode("day.activities").alias("activity_index", "configuration"))
    return days.select("plan_id", "session_index", "day.objective"), acts


def plan_tree(days: DataFrame, activities: DataFrame) -> DataFrame:
    """The plans again from their rows."""
    item = F.struct("activity_index", "configuration")
    acts = activities.groupBy("plan_id", "session_index").agg(F.array_sort(F.collect_list(item)).alias("a"))
    whole = days.join(acts, ["plan_id", "session_index"], "left")
    day = F.struct("session_index", "objective", F.coalesce(F.transform("a", lambda x: x.configuration), F.array().cast("array<string>")).alias("activities"))
    out = whole.groupBy("plan_id").agg(F.array_sort(F.collect_list(day)).alias("d"))
    return out.select("plan_id", F.transform("d", lambda x: F.struct(x.objective.alias("objective"), x.activities.alias("activities"))).alias("days"))


def with_id(payload: Column) -> Column:
    """A JSON object with an id: its own, or the hash of the payload in front of its other members. What is no JSON object is
    rejected and becomes null."""
    body = F.btrim(payload)
    rest = F.substring(body, 2, 2**31 - 1)
    between = F.when(F.btrim(rest) == "}", F.lit('"')).otherwise(F.lit('",'))
    held = F.when(F.get_json_object(body, "$.id").isNotNull(), body).otherwise(F.concat(F.lit('{"id":"'), F.sha2(payload, 256), between, rest))
    return F.when(body.startswith("{") & F.get_json_object(body, "$").isNotNull(), held)


def broadcast_batch(path: str):
    """A ``foreachBatch`` sink: add an id to payloads without one and append; replayed batches do not write twice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("payload", with_id(F.col("payload"))).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return write


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
