"""Cutting lineage through storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and continue from there.

    The folder is the one named in ``spark.checkpoint.dir``; only where that is
    unset and all tasks run on this machine (tests, local runs) a temporary
    folder is taken. Files go with the data they hold where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; otherwise the
    folder is the application's to remove.
    """
    _folder(df)
    return df.checkpoint(eager=True)


def stored(first: DataFrame, *more: DataFrame) -> DataFrame:
    """The same as :func:`materialise` in compressed columns, for tables that weigh as much as the input and are read several times.

    A read takes only the columns that it needs. The files stay until the folder is removed. Shuffle files
    of the plan that made the table go as soon as it is written, not when the driver happens to collect its garbage.
    A table may come in parts of one schema; they are made one after another, so only one part's shuffle files are there at a time.
    """
    session, path = first.sparkSession, f"{_folder(first)}/{uuid.uuid4()}"
    with shuffles_freed(session):
        for part in (first, *more):
            part.write.mode("append").option("compression", "zstd").parquet(path)
    return session.read.schema(first.schema).parquet(path)


@contextmanager
def shuffles_freed(session: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that are made and run inside go as each ends."""
    before = session.conf.get(CLEANUP, None)
    session.conf.set(CLEANUP, "true")
    try:
        # The setting counts when a plan is made.
        yield
    finally:
        session.conf.unset(CLEANUP) if before is None else session.conf.set(CLEANUP, before)


def _folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftlog-"))
    return context.getCheckpointDir()
