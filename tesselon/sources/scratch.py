"""Rows fixed in the folder that driver and executors share, for steps that read them more than once."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def fixed(df: DataFrame) -> DataFrame:
    """df, computed and written once by a reliable checkpoint; Spark removes it with spark.cleaner.referenceTracking.cleanCheckpoints.

    The folder is that of spark.checkpoint.dir. Only a local master (tests) may go without: it gets a temporary one.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc.getConf().get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="tesselon-"))
    return df.checkpoint()
