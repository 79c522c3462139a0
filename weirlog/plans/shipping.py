"""Make this package importable in Python workers, wherever the driver was started."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_done: set[str] = set()
#: Rows of one Arrow batch, where the session leaves Spark's default: whole texts come by the batch, and a batch of
#: 10,000 of them takes hundreds of MB in the JVM and in each Python worker.
BATCH_ROWS = 1_000
_ROWS_KEY, _ROWS_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"


def ship(spark: SparkSession) -> None:
    """Hand the package's source to the executors through Spark's own file server, once an application."""
    sc = spark.sparkContext
    if spark.conf.get(_ROWS_KEY) == _ROWS_DEFAULT:
        spark.conf.set(_ROWS_KEY, str(BATCH_ROWS))
    if sc.applicationId in _done:
        return
    folder_made = tempfile.mkdtemp(prefix="weirlog-code-")
    atexit.register(shutil.rmtree, folder_made, ignore_errors=True)
    path = os.path.join(folder_made, "weirlog_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(_ROOT):
            for n in sorted(names):
                if n.endswith((".py", ".json")):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join(os.path.basename(_ROOT), os.path.relpath(full, _ROOT)))
    sc.addPyFile(path)
    _done.add(sc.applicationId)
