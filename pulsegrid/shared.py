"""Session helpers: the shared folder, lineage cuts, and shipping this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Only a local session may leave it unset: its
    one machine then uses a temporary folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that driver and executors share (master {master})")
        found = f"file://{tempfile.mkdtemp(prefix='pulsegrid-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: lineage ends here, and a lost
    executor costs only its running tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def deal(df: DataFrame, keys: list[str]) -> DataFrame:
    """df dealt by keys into small partitions (eight times the session's number, up to 256 at least), which are not merged again: several windows over
    them each hold a sort of one partition."""
    own = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(own, min(8 * own, 256)), *keys)


def forget(*tables: DataFrame | None) -> None:
    """Delete tables that cut() wrote and that nothing later reads."""
    for t in tables:
        if t is not None and (path := getattr(t, "cut_path", None)):
            where = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that do not share the driver's PYTHONPATH."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parent
    into = Path(tempfile.mkdtemp(prefix="pulsegrid-zip-")) / "pulsegrid.zip"
    with zipfile.ZipFile(into, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, os.path.join(top.name, p.relative_to(top)))
    spark.sparkContext.addPyFile(str(into))
    _SHIPPED.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
