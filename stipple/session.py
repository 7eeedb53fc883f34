"""Session settings and durable intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def local_session(cores: int | str = 8, app: str = "stipple", **extra: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
        "spark.ui.showConsoleProgress": "false",
        **extra,
    }
    for k, v in settings.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: temporary folders of local-mode sessions, by application
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session without the setting gets a temporary folder; on
    a cluster a machine-local folder would be lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _LOCAL_DIRS:
        _LOCAL_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="stipple-")
    return _LOCAL_DIRS[context.applicationId]


class Scratch:
    """Written tables that cut the lineage of iterative jobs.

    A saved table survives the loss of executors and has exact size
    statistics, so the next plan picks its joins from real sizes.  ``save``
    alternates between two folders per name: an iteration may read the
    previous version while it writes the next, and disk use stays at two
    versions however long the loop runs.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
        self._turn: dict[str, int] = {}

    def save(self, df: DataFrame, name: str) -> DataFrame:
        turn = self._turn.get(name, 0)
        self._turn[name] = turn + 1
        path = f"{self.root}/{name}-{turn % 2}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame, label: str = "stage") -> DataFrame:
    """Materialise ``df`` once in the shared folder and read it back."""
    return Scratch(df.sparkSession, label).save(df, "t")
