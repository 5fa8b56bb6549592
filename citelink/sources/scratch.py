"""Tables in the cluster's shared folder, to end a lineage or to read a result several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def scratch_root(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where that is not set, a local session (tests) gets a folder of its own; a cluster must set it."""
    global _own
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="citelink-")
    return _own


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here and a lost executor costs nothing before it."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes the files of tables made by ``stored`` once nothing reads them any more."""
    for table in tables:
        spark = table.sparkSession
        jvm = spark.sparkContext._jvm
        root = scratch_root(spark).removeprefix("file:").lstrip("/")
        for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            if root in name:
                path = jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
