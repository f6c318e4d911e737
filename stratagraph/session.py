"""Session factory and the shared scratch area that long lineages are cut into."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, tuple[SparkSession, str]] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "stratagraph") -> SparkSession:
    """A session for tests and benches; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Only when the session names neither (single-machine tests) a temporary folder is set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="stratagraph-"))
    return context.getCheckpointDir()


def spread(df: DataFrame) -> DataFrame:
    """``df``, a plain scan, over all cores: a table of fewer splits than cores is dealt out evenly, any other stays where it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Parquet tables under the shared folder, used to cut lineage so that a lost executor costs no recomputation.

    Iterative operators write each round's state here and drop the round before; what is still there is
    removed when the Python process ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/stratagraph-{name}-{uuid.uuid4().hex}"
        self._n = 0
        _ROOTS[self.root] = (spark, self.root)

    def path(self, name: str = "t") -> str:
        self._n += 1
        return f"{self.root}/{name}-{self._n}"

    def write(self, df: DataFrame, name: str = "t", by: str | None = None) -> DataFrame:
        """Write ``df``, in folders by a column if one is named, and return it as read back; ``df.scratch_path`` names the folder."""
        path = self.path(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back.scratch_path = path
        return back

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "scratch_path", None)
        if path:
            _delete(self.spark, path)

    def clear(self) -> None:
        _ROOTS.pop(self.root, None)
        _delete(self.spark, self.root)


@atexit.register
def _clear_all() -> None:
    for spark, root in list(_ROOTS.values()):
        try:
            _delete(spark, root)
        except Exception:  # noqa: BLE001 - the JVM may be gone already
            pass
