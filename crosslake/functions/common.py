"""Small helpers that every operator uses: tables, ids, and lineage cuts that survive lost executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the dataset directory ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Gives this package to all executors, once for each context; operators with code of their own on the executors call it."""
    sc = spark.sparkContext
    if not getattr(sc, "_crosslake_shipped", False):
        package = Path(__file__).resolve().parents[1]
        if package.is_dir():  # else it came in an archive, as on an executor
            sc.addPyFile(shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name))
        sc._crosslake_shipped = True


def local_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver as a relation inside the plan: reading it takes no tasks, unlike a parallelized list."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = to_arrow_schema(T.StructType.fromDDL(schema))
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], names=kinds.names), schema)


def same_id(c: Column | str) -> Column:
    """The form in which two ids are equal: blanks around them trimmed, lower case."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def one_process(spark: SparkSession) -> bool:
    """Whether driver and executors are one process, as in a local session."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own; on a cluster
    a missing setting is an error, since a machine-local folder is lost with its machine.
    """
    said = spark.conf.get("spark.checkpoint.dir", None)
    if said:
        return said.rstrip("/")
    if not one_process(spark):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "crosslake-" + spark.sparkContext.applicationId)


_roots: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration() if jsc else jvm.org.apache.hadoop.conf.Configuration()).delete(p, True)


def release() -> None:
    """Deletes all tables written so far; results that have not been read or written yet are lost. For long sessions, between queries."""
    while _roots:
        _delete(*_roots.pop())


@atexit.register
def _clean() -> None:
    """The written tables of this program go with it; until then results may still read them."""
    try:
        release()
    except Exception:  # noqa: BLE001 - the JVM may be gone
        return


class Scratch:
    """Written tables that cut lineage; each is read back from the shared folder.

    A written table is computed once (``checkpoint()`` computes its last stage twice),
    is columnar, and lets the optimizer know its size.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}", 0
        self._paths: dict[int, str] = {}
        _roots.append((spark, self.root))

    def write(self, df: DataFrame, *by: str) -> DataFrame:
        """``by``: columns whose values get folders of their own, so that a filter on them reads no others."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def write_counted(self, df: DataFrame) -> tuple[DataFrame, int]:
        """The written table and its number of rows, counted as they pass."""
        seen = Observation(f"scratch-{uuid.uuid4().hex}")
        return self.write(df.observe(seen, F.count(F.lit(1)).alias("n"))), int(seen.get["n"])

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables of this scratch that no later step reads."""
        for df in tables:
            _delete(self.spark, self._paths.pop(id(df)))


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows in the same partitions for every later pass, kept in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/checkpoints")
    return df.checkpoint()


def latest(df: DataFrame, id_col: str, *order: Column) -> DataFrame:
    """One row for each id (equal after trimming and lower-casing): the first by ``order``.

    Rows with a null id are no records and are left out. The row limit is applied before
    the shuffle too, so an id with very many versions costs one row per input partition.
    """
    w = Window.partitionBy(same_id(id_col)).orderBy(*order)
    rn = "__rn"
    return df.where(F.col(id_col).isNotNull()).withColumn(rn, F.row_number().over(w)).where(F.col(rn) == 1).drop(rn)
