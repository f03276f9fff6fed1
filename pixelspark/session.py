"""Session and table helpers shared by the reference queries."""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Folders made since each `tidy` call that is under way began, the innermost last.
_made: list[list[str]] = []
_own_roots: dict[str, str] = {}


def local_session(cpus: int | str = "*", app: str = "pixelspark") -> SparkSession:
    """A local session with the settings the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where that is unset and the session is local, a temporary folder that goes with this process."""
    if root := spark.conf.get("spark.checkpoint.dir", None):
        return root
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if context.applicationId not in _own_roots:
        own = tempfile.mkdtemp(prefix="pixelspark-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        _own_roots[context.applicationId] = f"file://{own}"
    return _own_roots[context.applicationId]


def shared_dir(spark: SparkSession) -> str:
    """The path of a new folder that driver and executors share."""
    path = f"{_root(spark).rstrip('/')}/pixelspark-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append(path)
    return path


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*steps: DataFrame) -> None:
    """Deletes written steps that nothing reads any more."""
    for step in steps:
        jvm = step.sparkSession._jvm
        for folder in {f.rsplit("/", 1)[0] for f in step.inputFiles()}:
            if "/pixelspark-" in folder:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(step.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def _step_of(path: str) -> str | None:
    """The name of the shared folder that a file lies in."""
    found = re.search(r"/(pixelspark-[0-9a-f]{32}[^/]*)(/|$)", path)
    return found and found[1]


def tidy(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """f, after whose calls only those of the shared folders it has made are left that the frame it returns reads; the rest, written steps
    and the state of streams that have ended, is deleted. Calls may nest: what the inner frame reads is the outer call's to keep."""

    @functools.wraps(f)
    def run(*args, **kwargs) -> DataFrame:
        _made.append([])
        try:
            out = f(*args, **kwargs)
        finally:
            made = _made.pop()
        if made:
            spark = out.sparkSession
            read = {_step_of(file) for file in out.inputFiles()}
            hadoop = spark._jsparkSession.sessionState().newHadoopConf()
            for prefix in made:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{prefix}*")
                fs = path.getFileSystem(hadoop)
                for folder in fs.globStatus(path) or ():
                    if _step_of(folder.getPath().toString()) not in read:
                        fs.delete(folder.getPath(), True)
            if _made:
                _made[-1].extend(made)
        return out

    return run
