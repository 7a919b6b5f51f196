"""Session construction and lineage cutting."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a few bytes a row is broadcast only when it was counted and stays under this many rows.
BROADCAST_ROWS = 500_000
#: Other sides are broadcast up to this measured size; beyond it their rows are repeated for SALT parts of the other side.
BROADCAST_BYTES, SALT = 32 << 20, 16


def build_session(app: str = "pathloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine is written for; ``conf`` overrides any of them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    } | conf
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    return b.config(map=settings).getOrCreate()


def work_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate data: the one the cluster names in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is used, but only on one machine (``local`` masters, as in tests); on a
    cluster that would lose data with its executor, so it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    return os.path.join(tempfile.gettempdir(), "pathloom-checkpoints")


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and return the written form, so a lost executor costs nothing.

    Written data goes when it is no longer referenced, if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is on (as
    :func:`build_session` sets it).
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(work_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """True when ``df`` has at most ``limit`` rows, by a distributed count; ``df`` should be materialized."""
    return df.count() <= limit


def lookup_join(rows: DataFrame, table: DataFrame, on: list[str], spread: str, width: int | Column = 64, how: str = "inner") -> DataFrame:
    """Equi-join of many rows with a table that is sent to all tasks only if its measured size allows it.

    The size is the sum of ``width``, a row's bytes at most, as a number or an expression. A table that is too big is repeated ``SALT`` times and rows
    are spread over its copies by a hash of the column ``spread``, so that a key with a third of all rows is in many tasks.
    """
    table = materialize(table)
    width = F.lit(width) if isinstance(width, int) else width
    if table.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n")).first()["n"] <= BROADCAST_BYTES:
        return rows.join(F.broadcast(table), on, how)
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int"))
    return salted.join(table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), [*on, "__salt"], how).drop("__salt")
