"""Result tables and the collated hit file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionpairs import schemas


def write_by_set(df: DataFrame, path: str, by: str = "set_id", sets: DataFrame | None = None) -> None:
    """Replaces the folders of the sets in df. sets (column `by`): all sets that were worked on; the folders of those
    without rows are deleted after the others are written, so that any reader sees what was found and nothing else. Without
    it such sets keep theirs. One shuffle brings each set's rows together.

    Only names of emptied sets come to the driver, one after the other, which lists the folders in any case. A run that
    ends between writing and deleting is mended by repeating it.
    """
    df.hint("rebalance", by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if sets is None:
        return
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsparkSession.sessionState().newHadoopConf()
    folder = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
    for row in sets.select(F.col(by).cast("string")).distinct().join(df.select(F.col(by).cast("string")).distinct(), by, "left_anti").toLocalIterator():
        at = jvm.org.apache.hadoop.fs.Path(path, folder(by, row[0]))
        at.getFileSystem(conf).delete(at, True)


def read_by_set(spark: SparkSession, path: str) -> DataFrame:
    """What write_by_set wrote."""
    return spark.read.parquet(path)


def collated(hits: DataFrame) -> DataFrame:
    """The twelve columns of the collated file from hits with set_id and comparison."""
    return hits.select("set_id", "comparison", *schemas.COLLATED[2:]).toDF(*schemas.COLLATED)


def write_collated(hits: DataFrame, path: str, one_header: bool = False) -> None:
    """CSV with minimal quoting and CRLF line ends. Every part file has a header row, as Spark's readers expect; with
    one_header only the first, which holds nothing else, so that the parts one after the other are one file."""
    rows = collated(hits)
    if not one_header:
        rows.write.mode("overwrite").options(header=True, lineSep="\r\n", emptyValue="").csv(path)
        return
    line = F.to_csv(F.struct(*(F.col(f"`{c}`") for c in rows.columns)), {"emptyValue": ""})
    head = hits.sparkSession.range(0, 1, 1, 1).select(F.lit(",".join(rows.columns)).alias("value"))
    head.union(rows.select(line.alias("value"))).write.mode("overwrite").option("lineSep", "\r\n").text(path)
