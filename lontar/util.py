"""Helpers shared by the operators."""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lontar.session import shared_dir


def ship(module: str) -> None:
    """Send the functions of a module to the workers by value, so they need not have this package installed."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/lontar/{name}-{uuid.uuid4().hex[:12]}"


def small(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """df with a broadcast hint if it has been counted to hold no more than `rows` rows of a few short columns; else as it is, for a shuffled join."""
    df = cut(df)
    return F.broadcast(df) if df.count() <= rows else df


def scalar(df: DataFrame):
    """The one value of a one-row aggregate."""
    return df.first()[0]


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) == "", None).otherwise(c)


def need(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Exactly these columns, so that others in the input, whatever their names, cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
