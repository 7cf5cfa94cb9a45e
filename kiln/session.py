"""Session settings, table loading and lineage cuts shared by all operators."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, shuffle_partitions: int = 8, app: str = "kiln") -> SparkSession:
    """A session for tests and the bench; on a cluster the submitted session is used as it is."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and Spark runs in one process."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = os.path.join(tempfile.gettempdir(), "kiln-shared")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, survives the loss of executors. All files of an application lie in one folder of its id, which clear() and the end of the driver delete."""
    spark = df.sparkSession
    if not _cleared:
        # Later than the hooks of the gateway, so it runs before them.
        atexit.register(_at_end)
    _cleared.add(spark.sparkContext.applicationId)
    path = f"{_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete what cut() wrote for df, once nothing reads it any more: a round of a loop releases the round before."""
    if path := getattr(df, "_cut_path", None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all that cut() wrote in this application; results that are not written yet can then not be read."""
    _delete(spark, _folder(spark))


_cleared: set[str] = set()


def _at_end() -> None:
    spark = SparkSession.getActiveSession()
    try:
        if spark is not None and spark.sparkContext.applicationId in _cleared:
            clear(spark)
    except Exception:  # the gateway may be gone; the folder then stays for its owner to delete
        pass


#: Bytes of a task up to which rows are spread further where Python work per row is heavy.
SPREAD = 16 << 20


#: Nodes of a logical plan that shuffle, or run a job when they are planned.
_WIDE = re.compile(r"\b(?:Aggregate|Join|Repartition\w*|Rebalance\w*|Sort|Window|Distinct|Except|Intersect|GlobalLimit|Expand)\b")


def fine(df: DataFrame, factor: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """Spread rows over factor tasks a core, by the keys in by if given, where Python work per row is heavy and the table is small; larger ones are split well by their scan or shuffle, and so is a scan with a split for every core.

    Decided on the optimizer's plan and estimate of the size, so no job runs for it. Grouping by the same keys afterwards needs no further shuffle."""
    n = df.sparkSession.sparkContext.defaultParallelism * factor
    plan = df._jdf.queryExecution().optimizedPlan()
    if int(plan.stats().sizeInBytes()) >= n * SPREAD:
        return df
    if not by and not _WIDE.search(plan.toString()) and df._jdf.queryExecution().toRdd().getNumPartitions() >= n // 2:
        return df
    return df.repartition(n, *by)


def clustered(df: DataFrame, by: tuple[str, ...], order: tuple[str, ...] = ()) -> DataFrame:
    """df with all rows of equal keys in one task, beside each other and in order, for mapInPandas with groups(). The last step before it, as adaptive joins may split the keys again."""
    spread = fine(df, by=by)
    return (df.repartition(*by) if spread is df else spread).sortWithinPartitions(*by, *order)


def groups(batches: Iterator[pd.DataFrame], by: tuple[str, ...]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of whole groups of clustered() rows with the bounds of the groups in them; a group that goes on in the next batch waits for it."""
    waiting: list[pd.DataFrame] = []

    def bounds(b: pd.DataFrame) -> np.ndarray:
        new = np.zeros(len(b), bool)
        new[:1] = True
        for c in by:
            v = b[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not len(b):
            continue
        at = bounds(b)
        if waiting and any(waiting[-1][c].iloc[-1] != b[c].iloc[0] for c in by):
            whole = pd.concat(waiting, ignore_index=True)
            yield whole, np.append(bounds(whole), len(whole))
            waiting = []
        if len(at) == 1:
            waiting.append(b)
            continue
        whole = pd.concat([*waiting, b.iloc[: at[-1]]], ignore_index=True)
        yield whole, np.append(bounds(whole), len(whole))
        waiting = [b.iloc[at[-1] :]]
    if waiting:
        whole = pd.concat(waiting, ignore_index=True)
        yield whole, np.append(bounds(whole), len(whole))
