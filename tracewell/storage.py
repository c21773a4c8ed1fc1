"""Tables between the steps of a job: written to the shared folder, read back, dropped when no plan reads them."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

PLACE = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary folder is set
    once if driver and executors are one process; on a cluster that is an error, as parts of a table would stay
    on the machines that wrote them."""
    place = spark.conf.get(PLACE, None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{PLACE} must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set(PLACE, place)
    return place.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends here, and lost executors
    don't force the work above to run again."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_cut(*tables: DataFrame) -> None:
    """Delete the files of tables made by cut() that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
