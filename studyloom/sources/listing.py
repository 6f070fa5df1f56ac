"""Listing of objects by name: folders collapsed by a delimiter, pages by a cursor, both directions, search.

A table of objects has bucket, name, id, created_at and updated_at. An entry is a file or a folder, the part of a name behind
the prefix up to the first delimiter; entries are ordered by their names in bytes, folders with their delimiter, so a page
costs one scan of the range of names behind the cursor (which the source can prune), one aggregation and a top of
``max_keys`` rows, and never a sort of the listing.

Every row has a ``token``: given as ``next_token`` it goes on behind that row, whatever lies next to it, so the pages of any sizes
make up the whole listing. ``start_after`` takes a name as it is shown; where a file and a folder have one name it means the
folder.

Null names and objects of other buckets are not listed; max_keys of 0 or less lists nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The most rows that a search returns.
MOST = 1500
SORTS = ("name", "created_at", "updated_at")


def after(text: str) -> str | None:
    """The least text behind all that begin with ``text``; none if there is none."""
    for i in range(len(text) - 1, -1, -1):
        if ord(text[i]) < 0x10FFFF:
            return text[:i] + chr(ord(text[i]) + 1 if ord(text[i]) != 0xD7FF else 0xE000)
    return None


def _within(name: Column, prefix: str) -> Column:
    if not prefix:
        return F.lit(True)
    end = after(prefix)
    return (name >= prefix) & (name < end) if end else name >= prefix


def _behind(name: Column, token: str, prefix: str, delimiter: str, descending: bool) -> Column:
    """Names that belong to entries behind the entry of this token; a folder's ends with the delimiter."""
    if descending:
        return name < token
    end = after(token) if token.endswith(delimiter) and len(token) > len(prefix) else None
    return name >= end if end else name > token


def entry_of(name: Column, prefix: str, delimiter: str) -> Column:
    """The folder, with its delimiter, that a name lies in behind the prefix, or the name."""
    at = F.instr(F.substring(name, len(prefix) + 1, 2**31 - 1), delimiter)
    return F.when(at > 0, F.substring(name, F.lit(1), at + len(prefix) + len(delimiter) - 1)).otherwise(name)


def list_objects(objects: DataFrame, bucket, prefix: str = "", delimiter: str = "/", max_keys: int = 100, start_after: str = "", next_token: str = "", descending: bool = False) -> DataFrame:
    """name, id, created_at, updated_at (of files), is_folder, token: the next ``max_keys`` entries."""
    held = objects.where((F.col("bucket") == bucket) & F.col("name").isNotNull() & _within(F.col("name"), prefix))
    token = next_token
    if not token and start_after:
        folder = start_after + delimiter
        token = folder if held.where(_within(F.col("name"), folder)).limit(1).count() else start_after
    if token:
        held = held.where(_behind(F.col("name"), token, prefix, delimiter, descending))
    entry = entry_of(F.col("name"), prefix, delimiter)
    file = F.struct("id", "created_at", "updated_at")
    rows = held.withColumn("token", entry).groupBy("token").agg(F.max(F.when(F.col("name") == F.col("token"), file)).alias("file"))
    # a name that ends with the delimiter is in the folder of that name
    folder = F.col("token").endswith(delimiter) & (F.length("token") > len(prefix))
    named = rows.select(
        F.when(folder, F.rtrim(F.col("token"), F.lit(delimiter))).otherwise(F.col("token")).alias("name"),
        *(F.when(~folder, F.col(f"file.{c}")).alias(c) for c in ("id", "created_at", "updated_at")),
        folder.alias("is_folder"),
        "token",
    )
    return named.orderBy(F.desc("token") if descending else F.asc("token")).limit(max(max_keys, 0))


def search_by_timestamp(objects: DataFrame, bucket, prefix: str = "", limit: int = 100, level: int = 1, start_after: str = "", descending: bool = False, column: str = "created_at", column_after=None) -> DataFrame:
    """key, name, id, created_at, updated_at, is_folder: entries by time, a folder's being its first file's creation, then by
    name; behind the row of ``start_after`` and ``column_after`` (a timestamp), if a name is given."""
    held = objects.where((F.col("bucket") == bucket) & F.col("name").isNotNull() & _within(F.col("name"), prefix))
    held = held.withColumn("token", entry_of(F.col("name"), prefix, "/"))
    folder = F.col("token").endswith("/") & (F.length("token") > len(prefix))
    folders = held.where(folder).groupBy(F.rtrim("token", F.lit("/")).alias("name")).agg(F.min("created_at").alias("created_at"))
    folders = folders.select("name", F.lit(None).cast("long").alias("id"), "created_at", F.col("created_at").alias("updated_at"), F.lit(True).alias("is_folder"))
    files = held.where(~folder).select("name", F.col("id").cast("long").alias("id"), "created_at", "updated_at", F.lit(False).alias("is_folder"))
    rows = folders.unionByName(files)
    at = F.date_trunc("millisecond", F.col(column))
    if start_after:
        since = F.lit(column_after).cast(objects.schema[column].dataType) if column_after is not None else F.timestamp_seconds(F.lit(0))
        there, here = F.struct(since.cast("timestamp").alias("t"), F.lit(start_after).alias("n")), F.struct(at.cast("timestamp").alias("t"), F.col("name").alias("n"))
        rows = rows.where(F.col(column).isNotNull() & (here < there if descending else here > there))
    order = [F.coalesce(at.cast("timestamp"), F.timestamp_seconds(F.lit(0))), F.col("name")]
    keyed = rows.withColumn("key", F.split_part("name", F.lit("/"), F.lit(level)))
    return keyed.orderBy(*(o.desc() if descending else o.asc() for o in order)).limit(max(limit, 0)).select("key", "name", "id", "created_at", "updated_at", "is_folder")


def search(objects: DataFrame, bucket, prefix: str = "", limit: int | None = 100, level: int = 1, offset: int = 0, text: str = "", column: str | None = "name", descending: bool = False) -> DataFrame:
    """name, id, created_at, updated_at: entries whose names begin with prefix and text, whatever the case. By name, folders and files
    together; by a time, folders first, by name, then files by it."""
    limit = min(limit if limit is not None else 100, MOST)
    start = (prefix or "") + (text or "")
    column = (column or "name").lower() if (column or "name").lower() in SORTS else "name"
    low = F.lower("name")
    held = objects.where((F.col("bucket") == bucket) & F.col("name").isNotNull() & _within(low, start.lower()))
    part = F.split_part(F.col("name"), F.lit("/"), F.lit(level))
    nothing = [F.lit(None).cast(objects.schema[c].dataType).alias(c) for c in ("id", "created_at", "updated_at")]
    if column == "name":
        held = held.withColumn("token", entry_of(low, start.lower(), "/")).withColumn("deep", F.col("token").endswith("/") & (F.length("token") > len(start)))
        first = F.struct(low.alias("low"), "name")
        folders = held.where("deep").groupBy("token").agg((F.max(first) if descending else F.min(first)).getField("name").alias("name"))
        rows = folders.select("token", part.alias("name"), *nothing).unionByName(held.where("not deep").select("token", part.alias("name"), "id", "created_at", "updated_at"))
        order = [F.desc("token"), F.desc("id")] if descending else [F.asc("token"), F.asc("id")]
    else:
        depth = F.size(F.split("name", "/"))
        way = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
        folders = held.where(depth != level).select(part.alias("name")).distinct().select("name", *nothing, F.lit(0).alias("group"))
        files = held.where(depth == level).select(part.alias("name"), "id", "created_at", "updated_at", F.lit(1).alias("group"))
        rows = folders.unionByName(files)
        order = [F.asc("group"), way(F.when(F.col("group") == 0, F.col("name"))), way(column), F.asc("id")]
    return rows.orderBy(*order).offset(max(offset, 0)).limit(max(limit, 0)).select("name", "id", "created_at", "updated_at")


def search_v2(objects: DataFrame, bucket, prefix: str | None = "", limit: int | None = 100, level: int = 1, start_after: str = "", sort_order: str | None = "asc", sort_column: str | None = "name", column_after=None) -> DataFrame:
    """key, name, id, created_at, updated_at, is_folder: a page by name or by time; unknown orders and columns are asc and name."""
    limit = min(limit if limit is not None else 100, MOST)
    descending = (sort_order or "asc").lower() == "desc"
    column = (sort_column or "name").lower()
    if column not in SORTS or column == "name":
        page = list_objects(objects, bucket, prefix or "", "/", limit, start_after, "", descending)
        return page.withColumn("key", F.split_part("name", F.lit("/"), F.lit(level))).select("key", "name", "id", "created_at", "updated_at", "is_folder")
    return search_by_timestamp(objects, bucket, prefix or "", limit, level, start_after, descending, column, column_after)
