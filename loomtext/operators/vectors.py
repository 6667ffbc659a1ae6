"""Block-wise exact nearest neighbours: numpy inside tasks, Spark around them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    rows = column.to_pylist()
    ok = np.array([r is not None and None not in r for r in rows], bool)
    width = max((len(r) for r, o in zip(rows, ok, strict=True) if o), default=0)
    out = np.zeros((len(rows), width))
    for k, (r, o) in enumerate(zip(rows, ok, strict=True)):
        if o:
            out[k, : len(r)] = r
    return out, ok


def blockwise_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str, block: int) -> DataFrame:
    """(query id, vector id, score): the best k of each query within each batch of vectors.

    A grid: the stated queries are dealt to blocks of about `block`, and every part of the vectors meets each block in a
    group of its own, so a task holds one block of queries while a part of the vectors streams past it in Arrow batches.
    """
    vid, vec = vectors.columns
    qid, q = queries.columns
    spark = vectors.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    blocks = max(1, -(-queries.count() // block))
    part, share = F.pmod(F.xxhash64(vid), F.lit(parts)), F.pmod(F.xxhash64(qid), F.lit(blocks))
    numbers = lambda n: F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))
    left = vectors.select(F.explode(F.transform(numbers(blocks), lambda b: b * parts + part)).alias("part"), F.lit(1).alias("side"), F.col(vid).cast("string").alias("id"), vec)
    right = queries.select(F.explode(F.transform(numbers(parts), lambda p: p + parts * share)).alias("part"), F.lit(0).alias("side"), F.col(qid).cast("string").alias("id"), F.col(q).alias(vec))
    both = left.unionByName(right).repartition(parts * blocks, "part").sortWithinPartitions("part", "side")

    def search(v: np.ndarray, ids: list, qs: np.ndarray, q_ids: list) -> Iterator[pa.RecordBatch]:
        if metric == "euclid":
            scores = -np.sqrt(np.maximum(0, (qs**2).sum(1)[:, None] + (v**2).sum(1)[None] - 2 * qs @ v.T))
        else:
            scores = qs @ v.T
            if metric == "cosine":
                with np.errstate(invalid="ignore", divide="ignore"):
                    scores = scores / np.sqrt((qs**2).sum(1)[:, None] * (v**2).sum(1)[None])
        # all that reach the k-th best score, so that ties are settled later
        kth = np.partition(scores, -k, axis=1)[:, [-k]] if scores.shape[1] > k else np.full((len(qs), 1), -np.inf)
        r, c = np.nonzero(scores >= kth - 1e-9)
        yield pa.RecordBatch.from_arrays([pa.array([q_ids[i] for i in r], pa.string()), pa.array([ids[i] for i in c], pa.string()), pa.array(scores[r, c], pa.float64())], names=[qid, vid, "score"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, kept, kept_ids = None, [], []
        for batch in rows:
            parts_of, sides = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero(np.diff(parts_of * 2 + sides)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if parts_of[a] != part:
                    part, kept, kept_ids = parts_of[a], [], []
                m, ok = _matrix(batch.column(3).slice(a, b - a))
                ids = [i for i, o in zip(batch.column(2).slice(a, b - a).to_pylist(), ok, strict=True) if o]
                if sides[a] == 0:
                    kept.append(m[ok])
                    kept_ids += ids
                elif kept_ids:
                    asked = np.concatenate(kept)
                    for start in range(0, len(kept_ids), block):
                        yield from search(m[ok], ids, asked[start : start + block], kept_ids[start : start + block])

    found = both.mapInArrow(run, f"{qid} string, {vid} string, score double")
    return found.withColumns({qid: F.col(qid).cast(queries.schema[qid].dataType), vid: F.col(vid).cast(vectors.schema[vid].dataType)})
