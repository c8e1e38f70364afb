"""Session defaults the operators are written for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(app: str = "tallyweave", **conf: str) -> SparkSession:
    """A session with the defaults; keyword names use ``__`` for dots."""
    return SparkSession.builder.appName(app).config(map=DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, through Spark's own file distribution."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="tallyweave-")) / "tallyweave.zip"
    with zipfile.ZipFile(path, "w") as out:
        for f in sorted(top.rglob("*.py")):
            out.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only where none is set and all of Spark is this machine.

    Elsewhere a folder of one machine would lose rows without a word, so it is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="tallyweave-")
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


def run_dir(spark: SparkSession) -> str:
    """The application's own part of the shared folder; :func:`clean` removes it."""
    return f"{shared_dir(spark)}/tallyweave/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder and read it back.  Losing an executor loses nothing."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tallyweave_table = path
    sweep(spark)
    return out


def sweep(spark: SparkSession) -> None:
    """Let Spark delete the exchanges of plans that have ended; it does so when the driver collects its garbage, which may not be for half an hour."""
    spark._jvm.System.gc()


def drop(df: DataFrame) -> None:
    """Delete what :func:`materialize` has written for ``df``, which nothing reads any more."""
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._tallyweave_table)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def kept(df: DataFrame, name: str = "table") -> DataFrame:
    """``df`` as :func:`materialize` gives it, without a second copy of what it has written already."""
    return df if hasattr(df, "_tallyweave_table") else materialize(df, name)


_cleaned = 0


def once(df: DataFrame, name: str, make) -> DataFrame:
    """``make(df)``, written once for this ``df`` until :func:`clean`."""
    found = df.__dict__.setdefault("_tallyweave_once", {})
    if found.get(name, (None,))[0] != _cleaned:
        found[name] = _cleaned, materialize(make(df), name)
    return found[name][1]


def clean(spark: SparkSession) -> None:
    """Delete every table that this application has written to the shared folder; results that still read them end with it."""
    global _cleaned
    _cleaned += 1
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
