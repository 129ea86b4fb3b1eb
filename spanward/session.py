"""Session settings and the shared working folder."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


#: Partitions that per-row jobs deal small test tables out to; unset on a cluster.
SPREAD = "spark.spanward.spread"
#: Remove shuffle files when the statement that wrote them ends.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(app: str = "spanward", cores: str = "*", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config(SPREAD, str(os.cpu_count() if cores == "*" else int(cores)))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return prepare(builder.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Pin what results depend on (time is UTC) and what hot join keys depend on (adaptive skew joins)."""
    wanted = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
    }
    for key, value in wanted.items():
        if spark.conf.get(key) != value:
            spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (``spark.checkpoint.dir``).

    Only where the setting is absent in a local session, as in tests, a folder is made.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="spanward-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage so that what depends on one physical layout (such as
    range-partition bounds) is computed exactly once and survives lost executors.
    What was shuffled for it goes at once, not when the driver next collects garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(CLEAN_UP, "false")
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


def slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory; zone-less timestamps become UTC instants."""
    df = prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    casts = {
        f.name: F.col(f.name).cast("timestamp")
        for f in df.schema.fields
        if isinstance(f.dataType, T.TimestampNTZType)
    }
    return df.withColumns(casts) if casts else df


def small_table(spark: SparkSession, rows: list, schema: T.StructType | str) -> DataFrame:
    """A few driver-side rows as a local relation, which the optimizer folds and sizes exactly."""
    wanted = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = list(zip(*rows)) or [[] for _ in wanted.fields]
    nulls = [all(v is None for v in c) for c in columns]
    table = pa.table(
        {f.name: pa.array(list(c), pa.string() if n else None) for f, c, n in zip(wanted.fields, columns, nulls)}
    )
    return spark.createDataFrame(table).select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])


def read_texts(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    """A table of texts; ``keys`` identify a row, so that no group of rows is held together.

    Only a session that says so deals rows out first: test tables are one row group, which one task would read.
    """
    df = read_table(spark, sf_dir, name)
    parts = int(spark.conf.get(SPREAD, "0"))
    return df.repartition(parts, *keys) if parts else df


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers, for the few operators with Python tasks."""
    import shutil
    from pathlib import Path

    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spanward-")) / package.name
    archive = shutil.make_archive(str(target), "zip", package.parent, package.name)
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)
