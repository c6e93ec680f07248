"""Session helpers: the shared folder, table reading, local sessions for tests and the bench."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench share."""
    b = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidewell")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it
    wherever they run and however the driver found it. A worker is one task, so its linear algebra
    gets one thread unless the environment says otherwise."""
    app = spark.sparkContext.applicationId
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        spark.sparkContext.environment.setdefault(name, "1")
    if app in _SHIPPED:
        return
    root = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="tidewell-")) / "tidewell.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that every executor can read and write.

    It lies in the folder the cluster names in ``spark.checkpoint.dir``. Only where that is unset
    and the session is a one-machine ``local[...]`` one, a temporary folder takes its place; on a
    cluster without the setting this raises, because a machine-local folder would lose data.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tidewell-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tidewell-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it back."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
