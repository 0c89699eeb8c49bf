"""Tables that are worked out once: cut from their lineage, and safe from lost executors."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Most rows of a table that a join may broadcast.
BROADCAST_ROWS = 200_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` stored in the folder that ``spark.checkpoint.dir`` names.

    Only a local session that names none gets a temporary folder of its own.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="docgrid-"))
    return df.checkpoint()
