"""As-of, range and interval joins, sessions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, out: str) -> DataFrame:
    """left with the latest `value` of right at or before its time, per key.

    Both sides go into one ordered pass by key instead of a join of all pairs;
    of equal times the right side comes first, and of its rows the greatest value holds.
    """
    a = left.withColumn("__left", F.struct(*left.columns)).select(F.col(key), F.col(time), "__left", F.lit(None).cast(dict(right.dtypes)[value]).alias("__v"), F.lit(1).alias("__side"))
    b = right.select(F.col(key), F.col(time), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(time, "__side", "__v").rowsBetween(Window.unboundedPreceding, 0)
    joined = a.unionByName(b).withColumn(out, F.last("__v", ignorenulls=True).over(w)).filter("__side = 1")
    return joined.select("__left.*", out)


def range_join(points: DataFrame, at: str, ranges: DataFrame, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges that hold them (low <= at < high): an equi-join on buckets of `width`, then the exact test."""
    bucket = lambda c: F.floor(c / F.lit(width))
    dealt = ranges.withColumn("__bucket", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high)))))
    return points.withColumn("__bucket", bucket(F.col(at))).join(dealt, "__bucket").filter((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bucket")


def sessions(events: DataFrame, key: str, time: Column, gap_seconds: int) -> DataFrame:
    """events with `session`: a new one after more than `gap_seconds` of silence of its key."""
    w = Window.partitionBy(key).orderBy("__t", "event_id")
    marked = events.withColumn("__t", time).withColumn("__new", F.coalesce((F.col("__t") - F.lag("__t").over(w) > gap_seconds).cast("int"), F.lit(1)))
    return marked.withColumn("session", F.sum("__new").over(w)).drop("__new", "__t")


#: Query vectors in a block, and vectors multiplied with it at a time.
QUERY_BLOCK, VECTOR_CHUNK = 1024, 4096
#: Up to this many query vectors the blocks are broadcast (a vector of 1000 numbers is 8 kB); beyond it, both sides are shuffled in blocks.
BROADCAST_QUERIES = 20_000


def top_k_cosine(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors by cosine for each query row, but for itself: query_id, vec_id, score, rank.

    Queries go out in blocks; each task multiplies a chunk of vectors with a block and
    keeps k rows for each query, so that only those reach the merge. Vectors of another
    length than a query's, null ones and those of length zero have no score.
    """
    packed = lambda df, name, size: df.filter("embedding IS NOT NULL AND size(embedding) > 0").select(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-df.count() // size)))).alias("__b"), "vec_id", F.col("embedding").cast("array<double>").alias("e")).groupBy("__b").agg(F.collect_list(F.struct("vec_id", "e")).alias(name)).drop("__b")
    blocks, chunks = packed(queries, "q", QUERY_BLOCK), packed(vectors, "v", VECTOR_CHUNK)
    few = queries.limit(BROADCAST_QUERIES + 1).count() <= BROADCAST_QUERIES

    def nearest(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                q, v = batch.column("q")[i].as_py(), batch.column("v")[i].as_py()
                found = [[], [], []]
                for dim in sorted({len(x["e"]) for x in q}):
                    a, b = [x for x in q if len(x["e"]) == dim], [x for x in v if len(x["e"]) == dim]
                    if not b:
                        continue
                    x, y = (np.array([r["e"] for r in side]) for side in (a, b))
                    xn, yn = np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        score = np.round((x @ y.T) / (xn[:, None] * yn[None, :]), 6)
                    ids, own = np.array([r["vec_id"] for r in b]), np.array([r["vec_id"] for r in a])
                    score[(own[:, None] == ids[None, :]) | ~np.isfinite(score)] = -np.inf
                    order = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                    best = np.take_along_axis(score, order, axis=1)
                    rows, cols = np.nonzero(np.isfinite(best))
                    found[0].append(own[rows]), found[1].append(ids[order[rows, cols]]), found[2].append(best[rows, cols])
                if found[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in found], ["query_id", "vec_id", "score"])

    pairs = chunks.crossJoin(F.broadcast(blocks) if few else blocks)
    near = pairs.mapInArrow(nearest, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
