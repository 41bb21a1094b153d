"""Session helpers: settings, the shared folder and materialised tables."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SHARED_SETTING = "spark.checkpoint.dir"


def local_session(cpus: int = 8, app: str = "lodestone", memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the results rely on (UTC, adaptive execution)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers, once for each application.

    They import it whatever folder the driver was started in, and executors that join later get it too. The
    archive is written to the shared folder.
    """
    sc = spark.sparkContext
    if getattr(sc, "_lodestone_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # imported from an archive that is shipped already
        return spark
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{root.name}-{uuid.uuid4().hex}.zip")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.mkdirs(path.getParent())
    out = fs.create(path)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    sc.addPyFile(path.toString())
    sc._lodestone_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only where the setting is absent (a local test) a temporary folder of this machine is
    taken, once per session. With a cluster master an absent setting is an error, as a
    machine-local folder would not be seen by the executors.
    """
    conf = spark.sparkContext.getConf()
    found = conf.get(SHARED_SETTING, None) or spark.conf.get("lodestone.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError(f"{SHARED_SETTING} must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    spark.conf.set("lodestone.shared.dir", made)
    return made


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage with files that survive the loss of an executor. The path is new on
    every call, so a table is never read that another run wrote.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
