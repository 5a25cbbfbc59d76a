"""Session-level helpers shared by every operator."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes up to which a relation may be broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One Parquet table of a data directory; `schema` prunes nested leaves at the scan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the session. Where none is set, a session with a local master, whose only machine is
    this one, gets a temporary one; on a cluster it is an error, as executors can't reach a folder of the driver.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="foliolith-checkpoint-")
        atexit.register(shutil.rmtree, named, True)
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df`, marked for broadcast only if its estimated size is within `limit`."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def bounded_rows(df: DataFrame, most: int, what: str) -> list:
    """Rows of a relation that is small by contract; an error (never a cut) if it holds more than `most` rows."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; raise the documented bound")
    return rows


def pieces(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose sizes sum to at most `most` (single larger items stand alone)."""
    start = total = 0
    n = 0
    for n, size in enumerate(sizes, 1):
        if total and total + size > most:
            yield start, n - 1
            start, total = n - 1, 0
        total += size
    if n > start:
        yield start, n


#: White space at either end of a text (all code points with the White_Space property). Fixed values.
WHITE = "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trimmed(text: Column) -> Column:
    """`text` without surrounding white space of any kind."""
    return F.regexp_replace(text, f"^[{WHITE}]+|[{WHITE}]+$", "")
