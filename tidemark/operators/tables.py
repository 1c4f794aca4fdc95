"""Tables that are computed once and read several times."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder, with its lineage cut. The folder is that of spark.checkpoint.dir; where it is
    unset, a temporary one if driver and executors are one process. Elsewhere it must be set, as executors share no local folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        found = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint()
