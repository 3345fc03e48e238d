"""Access lists and vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type as arrow_type

from chronofold.operators.sync import assign_counters
from chronofold.sources.tables import new_folder, stored


def access_audit(keys: DataFrame, now: int, default_days: int = 30) -> DataFrame:
    """keys with expires_at filled (the midnight after now + days) where unset and not `never`, and valid."""
    midnight = ((now + default_days * 86_400) // 86_400 + 1) * 86_400
    expires = F.when(F.col("expires_at").isNull() & ~F.col("never"), F.lit(midnight).cast("long")).otherwise(F.col("expires_at"))
    valid = F.col("never") | F.col("expires_at").isNull() | (F.lit(now) < F.col("expires_at"))
    return keys.withColumn("valid", valid).withColumn("expires_at", expires)


def put_embeddings(held: DataFrame, new: DataFrame) -> DataFrame:
    """held with new(content_hash, model_id, vector) in the place of what has the same key."""
    keys = new.select("content_hash", "model_id").distinct()
    return held.join(keys, ["content_hash", "model_id"], "left_anti").unionByName(new)


def search(vectors: DataFrame, queries: DataFrame, k: int, block: int = 500) -> DataFrame:
    """query, id, cosine and rank of the k nearest vectors(id, vector) to each of queries(query, vector), itself left out.

    Brute force: queries are numbered and taken in blocks of `block`, each broadcast by itself. A task folds its vectors
    into lists of k for every query of the block, so that only k rows per query and task are shuffled; a block's result is
    written before the next one starts. Similarities are compared to 12 decimals, ties go by id; a vector of length 0 has
    no similarity (null) and comes last.
    """
    spark = vectors.sparkSession
    asked, ids = queries.schema["query"].dataType, vectors.schema["id"].dataType
    kind = pa.schema([("query", arrow_type(asked)), ("id", arrow_type(ids)), ("cosine", pa.float64())])
    numbered = stored(assign_counters(queries.select("query", "vector"), ["query"], 0, "n"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc_nulls_last("cosine"), "id"))
    shape = f"query {asked.simpleString()}, id {ids.simpleString()}, cosine double"
    root = new_folder(spark)
    spark.createDataFrame([], f"{shape}, rank int").write.parquet(root)
    for first in range(0, numbered.count(), block):  # each block adds to one table, so that the result reads as one
        held = spark.sparkContext.broadcast(numbered.filter(f"n >= {first} and n < {first + block}").select("query", "vector").toPandas())
        part = vectors.select("id", "vector").mapInArrow(nearest_in(held, k, kind), shape)
        part.withColumn("rank", rank).filter(F.col("rank") <= k).write.mode("append").parquet(root)
        held.unpersist()
    return spark.read.schema(f"{shape}, rank int").parquet(root)


def nearest_in(held: Broadcast, k: int, kind: pa.Schema, rows: int = 2000) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's k best vectors for every query of a broadcast block, `rows` vectors at a time."""

    def best(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["query", "cosine", "id"], ascending=[True, False, True]).groupby("query").head(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = held.value["query"].to_numpy()
        q = unit(held.value["vector"].tolist())
        found = []
        for b in (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows)):
            own = np.array(b.column(0).to_pylist())
            place = np.argsort(own, kind="stable")
            own = own[place]
            cosine = np.nan_to_num(np.round(q @ unit(b.column(1).to_pylist())[place].T, 12), nan=-2.0)
            cosine[names[:, None] == own[None, :]] = -3.0
            top = np.argsort(-cosine, axis=1, kind="stable")[:, :k]
            part = pd.DataFrame({"query": np.repeat(names, top.shape[1]), "id": own[top].ravel(), "cosine": np.take_along_axis(cosine, top, 1).ravel()})
            found = [best(pd.concat([*found, part[part.cosine > -3.0]]))]
        for part in found:
            yield pa.RecordBatch.from_pandas(part.assign(cosine=part.cosine.where(part.cosine > -2.0)), schema=kind, preserve_index=False)

    return run


def unit(vectors: list) -> np.ndarray:
    """Vectors of length 1; one of zeros becomes NaN."""
    rows = np.array(vectors, dtype=np.float64).reshape(len(vectors), -1)
    size = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, size, out=np.full_like(rows, np.nan), where=size > 0)
