"""Reading the input tables and the few session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The whole table ``name`` of the directory, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is named, local mode gets one of its own; on a cluster a
    folder of the driver's machine would lose data, so that raises."""
    current = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        current = tempfile.mkdtemp(prefix="vacantia-checkpoint-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` for a slow function: in ``spark.vacantia.spread`` partitions by hash of the keys where the session sets that
    (0: as it is), else in as many as there are cores where a file gives fewer. Rows and results are the same in any case."""
    wanted = df.sparkSession.conf.get("spark.vacantia.spread", None)
    if wanted is not None:
        return df.repartition(int(wanted), *keys) if int(wanted) else df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def lookup(rows: DataFrame, table: DataFrame, key: str, hot: int = 1000) -> DataFrame:
    """``rows`` left-joined with ``table``, which has at most one row for each ``key``.

    Keys that hold more than one of ``hot`` rows, so fewer than ``hot`` keys whatever the data, are joined to a broadcast
    of just their rows of ``table``; all others are joined by shuffle. So no task receives all rows of a frequent key.
    """
    total = rows.count()
    keys = [r[0] for r in rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") * hot > total).select(key).collect()] if total > hot else []
    if not keys:
        return rows.join(table, key, "left")
    is_hot = F.coalesce(F.col(key).isin(keys), F.lit(False))
    often = rows.filter(is_hot).join(F.broadcast(table.filter(F.col(key).isin(keys))), key, "left")
    return often.unionByName(rows.filter(~is_hot).join(table.filter(~F.col(key).isin(keys)), key, "left"))


def numbered(df: DataFrame, *order: Column, out: str) -> DataFrame:
    """``df``, materialised, with dense numbers from 0 in an order without ties: numbers within ranges of the order plus the
    sizes of the ranges before, so that no task sorts everything."""
    part, row = f"__{out}_part", f"__{out}_row"
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(row, F.monotonically_increasing_id())
    # The id holds the number of the partition above bit 33 and the row in it below.
    ranged = cut_lineage(ranged.withColumns({part: F.shiftright(row, 33), row: F.col(row).bitwiseAND(F.lit(2**33 - 1))}))
    sizes = ranged.groupBy(part).agg(F.count("*").alias("__n"))
    ahead = sizes.select(part, (F.sum("__n").over(Window.orderBy(part)) - F.col("__n")).alias("__ahead"))  # one row a partition
    return ranged.join(F.broadcast(ahead), part).withColumn(out, F.col(row) + F.col("__ahead")).drop(part, row, "__ahead")


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once for each application, so that it needn't be installed there."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="vacantia-")) / "vacantia.zip"  # on the driver only, which serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*")):
            if file.suffix in {".py", ".npz"}:
                z.write(file, Path(package.name) / file.relative_to(package))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
