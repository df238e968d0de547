"""Session helper for tests, the bench and local runs.

On a cluster the session is supplied by the job launcher; nothing in the
library sets configuration on a session it did not create.
"""

from __future__ import annotations

import tempfile
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int | str = 8, memory: str = "12g") -> SparkSession:
    """A local session with the settings the library is tuned for."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("veilscan")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # Recording a call site for every column expression slows plan building.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


@cache
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="veilscan-")


def work_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is
    unset on a local session (tests, trials) a fresh temporary folder is taken.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder on {master}")
    return _own_folder()


def settled(df: DataFrame) -> DataFrame:
    """The rows from a reliable checkpoint in the shared folder: they are computed once, and the lineage ends here."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_dir(df.sparkSession))
    return df.checkpoint()


def unsized(df: DataFrame) -> DataFrame:
    """A settled frame without the size that the planner takes it to have.

    A checkpoint keeps its plan's estimate, and that of a join or a cogroup is the
    product of both sides. In a loop over settled rows the number so gets several times
    as many digits with each round, until it alone fills the driver's memory.
    """
    session, rows = df.sparkSession, df._jdf
    return DataFrame(session._jsparkSession.internalCreateDataFrame(rows.queryExecution().toRdd(), rows.schema(), False), session)
