"""Written tables in the shared folder, and room for more."""

from __future__ import annotations

import gc
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from declcensus.operators.ordering import checkpoint_folder

_TURNS, _PAUSE = 4, 0.4


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again: for wide results, which
    take less room in this form than as a checkpoint."""
    path = f"{checkpoint_folder(df.sparkSession)}/{uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that are gone.

    Its cleaner hears of them only when the driver's JVM collects garbage, which may be much
    later than the last use; between the phases of a long job that is room on every executor.
    What Python let go of and what has just run is known to be gone with a delay, hence the turns.
    """
    for _ in range(_TURNS):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(_PAUSE)
