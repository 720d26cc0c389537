"""Settings that a stream's state depends on, stored beside it."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession


def keep_settings(spark: SparkSession, path: str, settings: Mapping[str, object]) -> None:
    """Store the settings at a stream's first start, and refuse others at later ones.

    State of one layout read under another gives wrong events without an error, so a
    restart with other settings fails here.
    """
    text = json.dumps(dict(settings), sort_keys=True)
    folder = f"{path.rstrip('/')}/settings"
    try:
        kept = spark.read.text(folder).head(1)
    except AnalysisException:
        kept = []
    if not kept:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    elif kept[0]["value"] != text:
        raise ValueError(f"the state below {path} was kept with {kept[0]['value']}, not {text}")
