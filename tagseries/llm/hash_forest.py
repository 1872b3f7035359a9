"""Operator 9, approximate nearest neighbours by a forest of hash prefixes.

Every vector gets one hash string of 32 bits per tree (signs of random projections, after the usual
lift that turns the largest inner product into the smallest angle).  Rows are dealt to blocks of about
``block_rows``; in a block, each tree is the sorted array of its strings.  A query descends in all
trees to its longest matching prefixes by binary search, then ascends in all of them together, one
bit at a time, until ``candidates`` different rows of the block are reached, and ranks those by the
exact inner product.  The best of all blocks are merged.

Nothing is fitted but the largest norm.  Queries go to blocks in chunks of ``chunk_rows``; a task holds
one block and one chunk, whatever the size of the table.  Vectors without structure need many
candidates: README has the recall measured.  A block with no more rows than ``candidates`` is
searched whole, so small tables are exact.

Edge cases: vectors that are null, empty, zero, or that hold null or non-finite components take no part, nor do
null ids.  Vectors of one length are searched among their own kind (each length has its blocks and its largest
norm).  Rows that repeat an id with other vectors are rows of their own, as queries and as candidates; rows equal in
both count once.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagseries.llm.common import stage

TREES, BITS, SEED = 24, 32, 7
BLOCK_ROWS, CHUNK_ROWS, CANDIDATES = 8192, 4096, 4096


def hash_strings(x: np.ndarray, largest: float, trees: int, seed: int, query: bool) -> np.ndarray:
    """One 32-bit string per row and tree."""
    size = np.linalg.norm(x, axis=1)
    if query:
        lifted = np.column_stack([x / size[:, None], np.zeros(len(x))])
    else:
        y = x / largest
        lifted = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (size / largest) ** 2))])
    planes = np.random.default_rng(seed).normal(size=(lifted.shape[1], trees * BITS))
    bits = (lifted @ planes > 0).reshape(len(x), trees, BITS)
    return (bits * (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))).sum(2)


def search_block(ids, own, x, qids, asks, q, largest: float, k: int, trees: int, candidates: int, seed: int):
    """(query, query id, id, score) of the best ``k`` of one block for each query of one chunk; ``own`` and ``asks``
    number the rows."""
    codes, want = hash_strings(x, largest, trees, seed, False), hash_strings(q, largest, trees, seed, True)
    order = np.argsort(codes, axis=0, kind="stable")
    arrays = [np.ascontiguousarray(codes[order[:, t], t]) for t in range(trees)]
    goal = min(candidates, len(ids))

    def ranges(level, rows):
        step = BITS - level
        low = (want[rows] >> step) << step
        return np.stack([(np.searchsorted(arrays[t], low[:, t]), np.searchsorted(arrays[t], low[:, t] + (1 << step)))
                         for t in range(trees)], 1)

    # descend: the deepest level at which the trees' ranges could hold enough rows
    level, open_ = np.zeros(len(q), np.int64), np.arange(len(q))
    for depth in range(BITS, 0, -1):
        lo, hi = ranges(depth, open_)
        enough = (hi - lo).sum(0) >= goal
        level[open_[enough]] = depth
        open_ = open_[~enough]
        if not len(open_):
            break
    found = [[], [], [], []]
    for depth in sorted(set(level.tolist()), reverse=True):
        wait = np.flatnonzero(level == depth)
        while len(wait):
            lo, hi = ranges(depth, wait)
            again = []
            for n, i in enumerate(wait):
                mark = np.zeros(len(ids), bool)
                for t in range(trees):
                    mark[order[lo[t, n]:hi[t, n], t]] = True
                if depth and mark.sum() < goal:  # ascend one bit in all trees
                    again.append(i)
                    continue
                near = np.flatnonzero(mark & (own != asks[i]))
                score = (x[near] * q[i]).sum(1)
                if len(near) > k:
                    best = np.flatnonzero(score >= np.partition(score, -k)[-k])
                    near, score = near[best], score[best]
                best = np.lexsort((ids[near], -score))[:k]
                for c, v in zip(found, (np.full(len(best), asks[i]), np.full(len(best), qids[i]), ids[near[best]], score[best]), strict=True):
                    c.append(v)
            wait, depth = np.array(again, np.int64), depth - 1
    return [np.concatenate(c) if c else np.zeros(0) for c in found]


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of rows that take part, v as doubles."""
    v = F.col(vec_col)
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = good & F.exists(v, lambda x: x != 0)
    return df.where(F.coalesce(good, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), v.cast("array<double>").alias("v")).distinct()


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, every: int = 20,
            trees: int = TREES, candidates: int = CANDIDATES, block_rows: int = BLOCK_ROWS,
            chunk_rows: int = CHUNK_ROWS, seed: int = SEED) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row whose id is divisible by ``every``."""
    rows = usable_vectors(df, id_col, vec_col).withColumn("row", F.monotonically_increasing_id())
    rows = stage(rows.withColumn("d", F.size("v")), "vectors")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    up = lambda n, per: F.greatest(F.lit(1), F.ceil(n / per)).cast("int")
    kinds = rows.groupBy("d").agg(
        up(F.count("*"), block_rows).alias("blocks"),
        up(F.count(F.when(F.col("id") % every == 0, 1)), chunk_rows).alias("chunks"), F.max(norm).alias("largest"))
    rows = rows.join(stage(kinds, "kinds"), "d")  # one row per length of vectors
    part = lambda c, m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int").alias(c)
    side = rows.select("d", part("block", "blocks"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
                       "row", "id", "v", "largest")
    asks = rows.where(F.col("id") % every == 0).select(
        F.col("d").alias("kind"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("to"), part("ask", "chunks"), F.col("row").alias("qrow"),
        F.col("id").alias("qid"), F.col("v").alias("qv"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        names = ["query", "query_id", "vec_id", "score"]
        if not len(left) or not len(right):
            return pd.DataFrame({c: [] for c in names})
        out = search_block(left["id"].to_numpy(), left["row"].to_numpy(), np.stack(left["v"].to_numpy()), right["qid"].to_numpy(),
                           right["qrow"].to_numpy(), np.stack(right["qv"].to_numpy()), left["largest"].iloc[0], k, trees, candidates, seed)
        return pd.DataFrame(dict(zip(names, out, strict=True)))

    found = side.groupBy("d", "block", "chunk").cogroup(asks.groupBy("kind", "to", "ask")).applyInPandas(
        search, "query bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
