"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word in operators 6 and 7, all ASCII but letters and digits, become spaces; A-Z become a-z.
ALNUM_FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder that driver and executors share.

    The place is spark.checkpoint.dir of the session. Only where that is unset, as in local tests, a folder of this
    machine is made and set for the session.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="chronofold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/chronofold-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class Folders(list):
    """Folders to remove; `seen` are all that were written, those taken off the list too."""

    def __init__(self) -> None:
        super().__init__()
        self.seen: list[str] = []

    def note(self, path: str) -> None:
        self.append(path)
        self.seen.append(path)

    def clear_but(self, needed: DataFrame) -> None:
        """Removes the folders of which `needed` reads nothing."""
        used = {part for file in needed.inputFiles() for part in file.split("/")}
        for path in [p for p in self if p.rsplit("/", 1)[1] not in used]:
            removed(needed.sparkSession, path)
            self.remove(path)
            self.seen.remove(path)


#: The folders that saved() writes within scratch().
_OWN: ContextVar[Folders | None] = ContextVar("own", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Folders]:
    """Removes at its end what saved() wrote in it, but for folders taken off the list it gives: these pass to a scratch around it."""
    own, outer = Folders(), _OWN.get()
    token = _OWN.set(own)
    try:
        yield own
    finally:
        _OWN.reset(token)
        for path in own.seen:
            if path in own:
                removed(spark, path)
            elif outer is not None:
                outer.note(path)


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: later steps survive lost executors and do not redo it."""
    path = shared_dir(df.sparkSession)
    if (own := _OWN.get()) is not None:
        own.note(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_written(df: DataFrame) -> bool:
    """Whether df reads one Parquet file or folder and does nothing else; a path in an unusual form may not be recognised."""
    files = df.inputFiles()
    folders = {f.rsplit("/", 1)[0] for f in files}
    if len(folders) != 1:
        return False
    for path in [*folders, *files[: len(files) == 1]]:
        for form in (path, path.replace("file:///", "file:/", 1), path.removeprefix("file://")):  # plans hold it as it was given
            try:
                if df.sameSemantics(df.sparkSession.read.schema(df.schema).parquet(form)):
                    return True
            except AnalysisException:  # such as a name that is escaped in inputFiles()
                pass
    return False


#: Keys that are broadcast to drop rows before a shuffle (some tens of MB); with more, the join that follows shuffles all rows.
MOST_KEYS = 400_000


def narrowed(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """rows of the keys: by a broadcast of the keys if they are few, else left to the join that follows."""
    keys = keys.select(column).distinct()
    few = keys.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return rows.join(F.broadcast(keys), column, "left_semi") if few else rows


@contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Texts are long: within it so many rows per Arrow batch keep a task's copies of them at a few MB."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    """A record batch of Python lists in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def alnum_words(text: str | None) -> list[bytes]:
    """Words of letters, digits and non-ASCII characters, A-Z folded, as UTF-8; a null text has none."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_FOLD).split() if text else []
