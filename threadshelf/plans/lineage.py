"""Cutting the lineage of intermediate results that are read more than once."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation, SparkSession

from threadshelf.session import shared_dir

# Folders of the job that runs in this thread, innermost last; each is deleted when its job ends.
# Jobs of other threads have their own.
_scopes: ContextVar[tuple[str, ...]] = ContextVar("scopes", default=())
_applications: set[str] = set()


def cut(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write to the shared folder and read back.

    Lost executors then cost no recomputation, every reader sees the same rows, and the
    size of the files tells the planner what it may broadcast. Texts are worth a stronger codec
    than the session's.
    """
    return _written(df, work_path(df.sparkSession, "cut"), codec)


def cut_counted(df: DataFrame, **aggregates: Column) -> tuple[DataFrame, dict]:
    """The same, with aggregates of the rows that are taken as they are written."""
    seen = Observation()
    written = cut(df.observe(seen, *[value.alias(name) for name, value in aggregates.items()]))
    return written, seen.get


def handed_on(df: DataFrame) -> DataFrame:
    """The same for the result of a job: it outlives the job, and goes with the one around it."""
    outer = _scopes.get()[:-1]
    return _written(df, _below(df.sparkSession, outer, "result"))


def _written(df: DataFrame, path: str, codec: str | None = None) -> DataFrame:
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below one folder per application and job."""
    return _below(spark, _scopes.get(), name)


def _below(spark: SparkSession, scopes: tuple[str, ...], name: str) -> str:
    return f"{scopes[-1] if scopes else _application(spark)}/{name}-{uuid.uuid4().hex}"


def _application(spark: SparkSession) -> str:
    """This application's folder; what is left of it goes when Python ends."""
    folder = f"{shared_dir(spark).rstrip('/')}/threadshelf/{spark.sparkContext.applicationId}"
    if folder not in _applications:
        _applications.add(folder)
        atexit.register(_delete_quietly, spark._jvm, spark._jsc.hadoopConfiguration(), folder)
    return folder


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Intermediate results written inside are deleted at the end.

    For a job that leaves its results in tables of their own, such as one micro-batch; what it
    hands back goes through `handed_on`.
    """
    path = work_path(spark, "job")
    token = _scopes.set((*_scopes.get(), path))
    try:
        yield
    finally:
        _scopes.reset(token)
        delete(spark, path)


def job(function: Callable) -> Callable:
    """Run a function, whose first or second argument knows the session, in a scope of its own."""

    @wraps(function)
    def run(*args, **named):
        spark = next(s for s in (_session(a) for a in (*args, *named.values())) if s is not None)
        with scratch(spark):
            return function(*args, **named)

    return run


def _session(value) -> SparkSession | None:
    return getattr(value, "sparkSession", None) or getattr(value, "spark", None)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system Spark can write to."""
    _delete(spark._jvm, spark._jsc.hadoopConfiguration(), path)


def _delete(jvm, configuration, path: str) -> None:
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(configuration).delete(target, True)


def _delete_quietly(jvm, configuration, path: str) -> None:
    try:
        _delete(jvm, configuration, path)
    except Exception:  # noqa: BLE001 - the JVM may have ended before
        pass
