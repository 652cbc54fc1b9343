"""Session, shared folder and size checks used by every operator."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is hinted for broadcast only when a measured row count stays below this.
BROADCAST_ROWS = 100_000


def local_session(cpus: str = "8", partitions: str = "8") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palimpsest")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see: spark.checkpoint.dir, or a temporary one in local mode only."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="palimpsest-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `stored` wrote, once nothing is computed from them any more."""
    for df in tables:
        SharedFolder(df.sparkSession, df._stored_at).delete("")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast df if a count shows that it has at most `limit` rows; otherwise leave the join to Catalyst and AQE."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def release() -> None:
    """Give a Python worker's free memory back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


class SharedFolder:
    """Small files in a folder that Spark can reach, whatever its file system; tables beside them are Spark's own."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self._gateway, self.path = spark._jvm, spark.sparkContext._gateway, path.rstrip("/")
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)
        self._fs.setVerifyChecksum(False)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._at(""))] if self._fs.exists(self._at("")) else []

    def read(self, name: str) -> str | None:
        if not self._fs.exists(self._at(name)):
            return None
        stream = self._fs.open(self._at(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file beside `name` and put it in its place by one rename."""
        fresh = self._at(name + ".new")
        stream = self._fs.create(fresh, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        how = self._gateway.new_array(kind, 1)
        how[0] = kind.valueOf("OVERWRITE")
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        context.rename(self._fs.makeQualified(fresh), self._fs.makeQualified(self._at(name)), how)

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)
