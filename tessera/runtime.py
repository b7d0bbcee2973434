"""Session, shared folder and table access."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "tessera") -> SparkSession:
    """A session for tests and the benchmark; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of `spark.checkpoint.dir`; set one of our own only where none is set and Spark is local."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = sc.getConf().get("spark.checkpoint.dir", "")
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; partitions and the order in them stay as they are."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once a session, so that Arrow functions can import it there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    archive = Path(tempfile.mkdtemp()) / f"{root.name}.zip"  # served to the executors by the driver
    archive.write_bytes(packed.getvalue())
    sc.addPyFile(str(archive))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """A plain scan with fewer splits than cores, dealt out over the cores, for work that is heavy by row. A scan of
    many splits, as any large table is, stays as it is."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan._jdf.queryExecution().toRdd().getNumPartitions() < cores else scan


def shards(df: DataFrame, bytes_each: int = 32 << 20, most: int = 400_000) -> int:
    """Partitions for a global sort of df: by the size of the tables it reads, at least one for each core; beyond `most`
    (13 TB) partitions grow instead, to 256 MB at 100 TB, as each has a row on the driver. Where a size is not known (rows of an RDD), its partitions count."""
    least, size = df.sparkSession.sparkContext.defaultParallelism, 0
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        bytes_ = int(str(leaf.stats().sizeInBytes()))
        if bytes_ < 1 << 60:
            size += bytes_
        elif leaf.nodeName().startswith("LogicalRDD") or hasattr(leaf, "rdd"):
            least = max(least, leaf.rdd().getNumPartitions())
    return max(least, min(most, -(-size // bytes_each)))
