"""The given tables seen as image tables, in Spark and in SQL, for the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_IMAGE = {
    "file": "p_partkey",
    "pos": "p_partkey",
    "width": "cast(64 + (p_partkey * 37) % 2900 as int)",
    "height": "cast(48 + p_size * 41 + (p_partkey * 13) % 700 as int)",
    "format": "case p_partkey % 5 when 0 then 'png' when 1 then 'jpg' when 2 then 'webp' when 3 then 'bmp' else 'gif' end",
    "has_alpha": "p_partkey % 3 = 0",
    "file_size": "cast(p_retailprice * 100 as bigint) + p_partkey",
    "sharpness": "cast((p_partkey * 7) % 1500 as double)",
    "contrast": "cast((p_partkey * 11) % 97 as double)",
    "grp": "case when p_partkey % 7 = 0 then null else cast(p_partkey % 40 as bigint) end",
    "path": "concat(case when p_partkey % 2 = 0 then '/in/' else '/other/' end, replace(p_name, ' ', '.'), case p_partkey % 3 when 0 then '.png' when 1 then '.jpeg' else '' end)",
    "text": "concat(replace(p_name, ' ', ', '), ', ', lower(p_type), ', ', lower(p_brand), case when p_partkey % 4 = 0 then ', , red ' else '' end)",
}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as images: sizes, formats, groups, paths and tags from its columns."""
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} as {k}" for k, v in _IMAGE.items()])


IMAGES_SQL = "images as (select " + ", ".join(f"{v} as {k}" for k, v in _IMAGE.items()) + " from part)"


def with_images(sql: str) -> str:
    return f"with {IMAGES_SQL} {sql}"
