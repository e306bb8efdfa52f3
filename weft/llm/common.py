"""What the corpus operators share: the shared folder, word patterns, row keys."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, and words as runs of anything else.
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Only a local session may lack the setting; it then gets a folder of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _local:
            _local.append(tempfile.mkdtemp(prefix="weft-shared-"))
        found = _local[0]
    return found.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/weft-{label}-{uuid.uuid4().hex}"


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Deletes the tables written inside by materialise() when it ends, but for those marked `outer`."""
    _scopes.append([])
    try:
        yield
    finally:
        for df in _scopes.pop():
            discard(df)


def materialise(df: DataFrame, label: str, outer: bool = False, compression: str = "snappy", options: dict | None = None) -> DataFrame:
    """Write once as Parquet in the shared folder and read back, which cuts the lineage.

    The innermost scratch_scope deletes it, or with `outer` the next one around. `options` are those of the Parquet writer.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", compression).options(**(options or {})).parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._weft_path = path
    level = -2 if outer else -1
    if len(_scopes) >= -level:
        _scopes[level].append(written)
    return written


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared file system, whatever it holds."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*frames: DataFrame) -> None:
    """Delete the files behind frames from materialise() that nothing reads any more."""
    for df in frames:
        delete(df.sparkSession, df._weft_path)


def word_array(text: Column) -> Column:
    """Words of a text; none for null, empty or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def let(value: Column, body) -> Column:
    """Bind a costly expression once and use it several times in `body`."""
    return F.element_at(F.transform(F.array(value), body), 1)


def unused(df: DataFrame, stem: str) -> str:
    """A column name that df does not have, in any case of letters."""
    taken, name = {c.lower() for c in df.columns}, f"__weft_{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def is_held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text leaves no remainder; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0
