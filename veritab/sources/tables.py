"""Tables that a plan leaves on its way, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Paths and catalog tables that plans of this process have left, oldest first.
_LEFT: list[tuple[str, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a local session that does not name one."""
    try:
        found = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # not set in this session
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="veritab-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/veritab-{label}-{uuid.uuid4().hex}"
    _LEFT.append(("path", path))
    return path


def new_table(label: str) -> str:
    name = f"veritab_{label.replace('-', '_')}_{uuid.uuid4().hex}"
    _LEFT.append(("table", name))
    return name


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def mark() -> int:
    """A place to sweep from."""
    return len(_LEFT)


def sweep(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> int:
    """Delete what plans have left since mark(); returns how many paths and tables.

    For results that have been written: a plan that still reads one of the
    tables fails afterwards, unless `keep` names its path.
    """
    going = [x for x in _LEFT[since:] if x[1] not in keep]
    for kind, name in going:
        if kind == "table":
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        else:
            delete_path(spark, name)
    _LEFT[since:] = [x for x in _LEFT[since:] if x[1] in keep]
    return len(going)


def written(df: DataFrame, label: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: its plan is a scan, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
