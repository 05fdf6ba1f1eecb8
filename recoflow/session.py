"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "recoflow",
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Local/test session. On a cluster, use the session the platform provides."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 << 20))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``recoflow`` importable in the Python workers (once per application).

    Functions given to ``mapInPandas`` are pickled by module reference, so the
    workers must import this package wherever the driver found it.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="recoflow-pkg-"), "recoflow.zip")
    with zipfile.ZipFile(path, "w") as z:
        for dirpath, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(dirpath, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_root(spark: SparkSession) -> str:
    """Reliable shared folder for checkpoints and hand-off tables.

    Uses the cluster's ``spark.checkpoint.dir`` when set. Only a local session
    (tests, bench) may fall back to a private temporary folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if not _is_local(spark):
        raise RuntimeError("spark.checkpoint.dir is not set; configure a shared folder for this cluster")
    path = tempfile.mkdtemp(prefix="recoflow-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for a written table."""
    root = checkpoint_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df):
    """Write the table once as Parquet in the shared folder and read it from there: lineage is cut, columns can be pruned."""
    path = scratch_path(df.sparkSession, "handoff")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize_bucketed(df, keys: list[str], buckets: int | None = None):
    """As ``materialize``, in buckets of the keys, as many as there are shuffle partitions unless given: joins and groups on the keys read them without a shuffle.

    Rows that come out of a group by the same keys already lie in these buckets, so that the write needs no shuffle either.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "handoff")
    name = f"handoff_{uuid.uuid4().hex}"
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    out = spark.table(name)
    out.handoff = name, path
    return out


def drop_handoff(df) -> None:
    """Removes a table of ``materialize_bucketed`` from which nothing is computed any more."""
    spark, (name, place) = df.sparkSession, df.handoff
    spark.sql(f"drop table {name}")
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def checkpointed(df):
    """Reliable checkpoint in the shared folder, for callers that need the partitions and their order kept."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)
