"""Registered queries of listing and search: objects are the pages, named by their addresses. Several pages of each listing are taken
one by one, each from the token of the last row of the page before."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from ..sources import listing

Run = Callable[[SparkSession, str], DataFrame]
PAGE = 40


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    created = F.lit("2024-01-01").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), ((F.col("page_id") * 37) % 5000).cast("int"))
    name = F.regexp_replace("url", "^[a-z]+://", "")
    return pages.select((F.col("page_id") % 2).alias("bucket"), F.when(F.col("page_id") % 5 == 0, F.upper(name)).otherwise(name).alias("name"), F.col("page_id").alias("id"), created.alias("created_at"), (created + F.make_dt_interval(F.lit(1))).alias("updated_at"))


def obj_list_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three pages of bucket 1 in each direction, folders collapsed."""
    objects, pages = _objects(spark, sf_dir), []
    for descending in (False, True):
        token = ""
        for number in range(3):
            page = stored(listing.list_objects(objects, 1, max_keys=PAGE, next_token=token, descending=descending))
            pages.append(page.select(F.lit("desc" if descending else "asc").alias("way"), F.lit(number).alias("page"), "name", "id", "is_folder"))
            last = page.agg(F.min("token") if descending else F.max("token")).first()[0]
            if last is None:
                break
            token = last
    return reduce(DataFrame.unionByName, pages)


def obj_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _objects(spark, sf_dir)
    by_name = listing.search(objects, 0, "t", PAGE, 1, 3).withColumn("sorted", F.lit("name"))
    by_time = listing.search(objects, 1, "", 2 * PAGE, 1, 5, column="updated_at", descending=True).withColumn("sorted", F.lit("updated_at"))
    return by_name.unionByName(by_time).select("sorted", "name", "id")


def obj_search_by_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects, pages = _objects(spark, sf_dir), []
    name, at = "", None
    for number in range(3):
        page = stored(listing.search_by_timestamp(objects, 0, limit=PAGE, level=1, start_after=name, column_after=at, descending=True))
        pages.append(page.select(F.lit(number).alias("page"), "key", "name", "id", "created_at", "is_folder"))
        last = page.orderBy("created_at", "name").first()
        if last is None:
            break
        name, at = last["name"], str(last["created_at"])
    return reduce(DataFrame.unionByName, pages)


def obj_search_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = _objects(spark, sf_dir)
    by_name = listing.search_v2(objects, 1, None, None, 1, "m", "ASC", "size")
    by_time = listing.search_v2(objects, 1, "", PAGE, 1, "", "desc", "updated_at")
    return by_name.select(F.lit("name").alias("sorted"), "key", "name", "id").unionByName(by_time.select(F.lit("updated_at").alias("sorted"), "key", "name", "id"))


_OBJECTS = """with objects as (select page_id % 2 as bucket, case when page_id % 5 = 0 then upper(regexp_replace(url, '^[a-z]+://', '')) else regexp_replace(url, '^[a-z]+://', '') end as name, page_id as id, timestamp '2024-01-01' + to_minutes((page_id * 37) % 5000) as created_at from pages where url is not null),
entries as (select bucket, case when contains(name, '/') then split_part(name, '/', 1) || '/' else name end as token, min(created_at) as created_at, case when contains(any_value(name), '/') then null else max(id) end as id from objects group by bucket, token),
named as (select *, rtrim(token, '/') as name, right(token, 1) = '/' as is_folder from entries)"""

#: key -> query, and its SQL for the independent engine
QUERIES: dict[str, tuple[Run, str]] = {
    "obj_list_delimiter": (
        obj_list_delimiter,
        _OBJECTS
        + f", up as (select *, row_number() over (order by token) as rn, row_number() over (order by token desc) as back from named where bucket = 1) select 'asc' as way, cast((rn - 1) // {PAGE} as int) as page, name, id, is_folder from up where rn <= {3 * PAGE} union all select 'desc', cast((back - 1) // {PAGE} as int), name, id, is_folder from up where back <= {3 * PAGE}",
    ),
    "obj_search": (
        obj_search,
        _OBJECTS
        + f""", low as (select lower(split_part(name, '/', 1)) as token, arg_min(split_part(name, '/', 1), (lower(name), name)) as name, case when max(case when contains(name, '/') then 1 else 0 end) = 1 then null else max(id) end as id from objects where bucket = 0 and left(lower(name), 1) = 't' group by lower(split_part(name, '/', 1))),
        placed as (select *, row_number() over (order by token) as rn from low),
        folders as (select distinct split_part(name, '/', 1) as name from objects where bucket = 1 and contains(name, '/')),
        times as (select name, cast(null as bigint) as id, row_number() over (order by name desc) as rn from folders union all select name, id, (select count(*) from folders) + row_number() over (order by created_at desc, id) from objects where bucket = 1 and not contains(name, '/'))
        select 'name' as sorted, name, id from placed where rn > 3 and rn <= {3 + PAGE} union all select 'updated_at', name, id from times where rn > 5 and rn <= {5 + 2 * PAGE}""",
    ),
    "obj_search_by_timestamp": (
        obj_search_by_timestamp,
        _OBJECTS + f", placed as (select *, row_number() over (order by created_at desc, name desc) as rn from named where bucket = 0) select cast((rn - 1) // {PAGE} as int) as page, name as key, name, id, created_at, is_folder from placed where rn <= {3 * PAGE}",
    ),
    "obj_search_v2": (
        obj_search_v2,
        _OBJECTS + f", a as (select name, id, row_number() over (order by token) as rn from named where bucket = 1 and token > 'm'), b as (select name, id, row_number() over (order by created_at + case when is_folder then interval 0 day else interval 1 day end desc, name desc) as rn from named where bucket = 1) select 'name' as sorted, name as key, name, id from a where rn <= 100 union all select 'updated_at', name, name, id from b where rn <= {PAGE}",
    ),
}
