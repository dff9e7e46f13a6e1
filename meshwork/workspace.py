"""Tables that a run writes once to the shared folder and reads again: they cut lineage and outlive lost executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Of a file:// folder: without native Hadoop code the checksummed file system starts a chmod process for each file, and while a process starts,
#: the executor's memory counts twice. Other file systems are not concerned.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: The folder of each local application that names none itself.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where that is unset, a local master gets a folder of its own, a cluster an error."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = f"file://{tempfile.mkdtemp(prefix='meshwork-')}"
    return _LOCAL[app]


class Workspace:
    """A folder for the tables of one run.

    ``put`` and ``buckets`` write and reread, ``drop`` deletes what no later plan reads. What is left goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.bucketed: dict[str, str] = {}
        atexit.register(self.drop)

    def at(self, name: str) -> str:
        return f"{self.path}/{name}.parquet"

    def put(self, name: str, df: DataFrame, *by: str) -> DataFrame:
        """Write and reread a table, in a folder for each value of the columns by."""
        df.write.options(**PLAIN_FILES).mode("overwrite").partitionBy(*by).parquet(self.at(name))
        return self.spark.read.schema(df.schema).parquet(self.at(name))

    def buckets(self, name: str, df: DataFrame, n: int, *keys: str) -> DataFrame:
        """A table in n buckets of the keys, each one sorted file, so that a join by the keys does not move it again."""
        table = f"meshwork_{uuid.uuid4().hex}"
        df.repartition(n, *keys).write.options(**PLAIN_FILES).mode("overwrite").format("parquet").bucketBy(n, *keys).sortBy(*keys).option("path", self.at(name)).saveAsTable(table)
        self.bucketed[name] = table
        return self.spark.table(table)

    def drop(self, *names: str) -> None:
        if self.spark.sparkContext._jsc is None:
            return
        for name in names or list(self.bucketed):
            if name in self.bucketed:
                self.spark.sql(f"DROP TABLE IF EXISTS {self.bucketed.pop(name)}")
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for at in [self.at(n) for n in names] or [self.path]:
            path = jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(conf).delete(path, True)
