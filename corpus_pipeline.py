"""The training-data pipeline: raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet to the shared folder and read
again as the next stage's docs. A stage that drops rows returns the rows of docs but those it found, which alone it has
written; the other stages return what they have written. What else a stage writes is removed at its end. All but the last
return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm import decontaminate, language, neardup, packing, substrings
from chronofold.llm.common import MOST_KEYS, is_written, saved, scratch, small_batches, table

#: SQL cannot express the stages (trained models, packing); tests hold them against brute force.
ORACLE_SQL = None


#: A row's own key within a stage's input; ids may be null, repeat, or stand on different texts.
ROW = "__row"


#: Rows of one file that have keys of their own.
FILE_ROWS = 1 << 40


def keyed(docs: DataFrame) -> DataFrame:
    """docs with ROW, the same key of a row at every reading: number of its file and place there, if docs is read as it was
    written, so that no copy is made; of other docs a copy is written once with the keys."""
    if not is_written(docs):
        return saved(docs.withColumn(ROW, F.monotonically_increasing_id()))
    rows = docs.withColumn("__meta", docs.metadataColumn("_metadata"))
    rows = rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("__meta.file_path").alias("__file"), F.col("__meta.row_index").alias("__place"))
    names = sorted(r[0] for r in rows.select("__file").distinct().collect())  # names of files only
    numbers = docs.sparkSession.createDataFrame(pa.table({"__file": pa.array(names, pa.string()), "__number": pa.array(range(len(names)), pa.int64())}))
    rows = rows.join(F.broadcast(numbers), "__file")
    return rows.withColumn(ROW, F.col("__number") * FILE_ROWS + F.col("__place")).drop("__file", "__place", "__number")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows of keyed rows but those in gone(ROW), without the key: while these are few by broadcast, so that texts are not shuffled."""
    gone = saved(gone.select(ROW))
    few = gone.limit(MOST_KEYS + 1).count() <= MOST_KEYS
    return rows.join(F.broadcast(gone) if few else gone, ROW, "left_anti").drop(ROW)


def tidy(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """The stage, and all that it wrote removed but what its result reads: copies of the corpus do not pile up."""

    @wraps(stage)
    def run_and_clear(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch(spark) as own, small_batches(spark):
            out = stage(spark, docs, sf_dir)
            own.clear_but(out)
            own.clear()  # what the result reads stays
        return out

    return run_and_clear


@tidy
def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language no evidence explains (operator 9)."""
    rows = keyed(docs)
    return without(rows, language.identify(rows, table(spark, sf_dir, "pages"), carry=(ROW,)).filter("not kept"))


@tidy
def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate group (operator 4): of the smallest doc_id, rows without one come last.

    Every row is a node of its own, whatever its doc_id. Of repeated rows without any word, one stays.
    """
    rows = keyed(docs)
    found = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), width=5)
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    same = F.when(wordless, F.sha2(F.to_json(F.struct(*docs.columns)), 256))
    members = rows.select(ROW, F.col("doc_id").cast("long").alias("id"), same.alias("same"))
    members = members.join(found.select(F.col("doc_id").alias(ROW), "component_id"), ROW)
    members = saved(members.select(ROW, "id", F.coalesce("same", F.col("component_id").cast("string")).alias("group")))
    first = members.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("n"), "id", ROW)).alias("m")).select(F.col(f"m.{ROW}"))
    return without(rows, members.join(first, ROW, "left_anti"))


@tidy
def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes byte strings of 200 and more that repeat in what is left (operator 5)."""
    return saved(substrings.cleaned(docs))


@tidy
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold ten words in a row of a benchmark item (operator 6)."""
    rows = keyed(docs)
    scanned = decontaminate.scan(rows.select(F.col(ROW).alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(rows, scanned.filter("n_hit > 0").select(F.col("doc_id").alias(ROW)))


@tidy
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the remaining documents into sequences of 1024 tokens (operator 3)."""
    packed = packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, public_tokenizers.path("byte_bpe_50k.json"),
        digest=packing.piece_crc32, digest_type="long",
    )
    return saved(packed.withColumnRenamed("digest", "ids_crc32"))


STAGES = [
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substrings", substring_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as own:
        for _, stage in STAGES:
            out = stage(spark, docs, sf_dir)
            docs = out if is_written(out) else saved(out)
            own.clear_but(docs)  # the stage's own docs are no longer needed
        own.clear()
    return docs
