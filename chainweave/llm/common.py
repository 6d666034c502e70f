"""What the operators of this subpackage share: tables, words and cut lineage."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters between words.
SPACES = "\\x20\\x09-\\x0D"
SPACE_CHARS = " \t\n\x0b\x0c\r"

_own_dir: str | None = None
#: Tables written and not yet deleted, in order.
_made: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a folder of this process's own, which only a local master can use."""
    global _own_dir
    if base := spark.conf.get("spark.checkpoint.dir", None):
        return base.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="chainweave-")
        atexit.register(shutil.rmtree, _own_dir, ignore_errors=True)
    return _own_dir


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_dir(spark)}/chainweave/{label}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, written once to the shared folder and read from there: lost executors cost no recomputation of what came before."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """A place in the order of written tables, for drop_since."""
    return len(_made)


def drop_since(spark: SparkSession, place: int, *keep: DataFrame) -> None:
    """Deletes tables that this process has written since `place`, apart from those that `keep` read. For steps whose results are themselves written."""
    kept = {f for df in keep for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for path in _made[place:]:
        if not any(f"/{path.rsplit('/', 1)[-1]}/" in f for f in kept):
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
            _made.remove(path)


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like these, longer where df has a column of such a name in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def word_array(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    inner = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACES}]+"))


def chars_of(text: Column, chars: str) -> Column:
    """Number of characters of text that are among chars."""
    return F.char_length(text) - F.char_length(F.translate(text, chars, ""))


#: Bytes of rows that a Python worker is handed at a time; a batch ends with the row that reaches them.
BATCH_BYTES = 4 << 20


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """df.mapInArrow in batches of BATCH_BYTES, which bounds what a task keeps of the texts on either side. This is a setting of the session, read when the plan runs; it changes no result."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


_held: dict[tuple, object] = {}


def held(name: tuple, make: Callable[[], object]) -> object:
    """What a Python worker keeps between tasks: the last such object only, made anew when another one has been held since."""
    if name not in _held:
        release()
        _held[name] = make()
    return _held[name]


def release() -> None:
    """Gives a Python worker's held object, and memory that is free, back to the system. Workers serve many stages, and each stage's tasks start with this or with held."""
    _held.clear()
    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # a C library without it
