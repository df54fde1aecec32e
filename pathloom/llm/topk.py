"""Exact top-k by inner product: columnar branch and bound over blocks of vectors.

A cell keeps its vectors by dimension (a row of the array for each dimension). Scores accumulate dimension block by
dimension block; after each, a candidate's best possible score is its sum so far plus the product of the remaining
norms of query and candidate, and candidates below the query's k-th score so far are dropped and the rest compacted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 5
DIMENSIONS = 16
#: About as many queries and rows meet in one task.
QUERIES_A_CELL, ROWS_A_CELL = 1024, 8192
#: Parts whose leading rows are merged in one step.
MERGED = 64


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """``(id, v)``: floor(scale * x) of each component as a double; rows with a null vector, a null, infinite or NaN component are left out."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & ~bad)
    return good.select(F.col(id_col).cast("long").alias("id"), F.transform(vector_col, lambda x: F.floor(x.cast("double") * float(scale))).alias("v"))


def best(queries: tuple[np.ndarray, np.ndarray], rows: tuple[np.ndarray, np.ndarray], k: int, dims: int = DIMENSIONS) -> list[tuple[int, int, int]]:
    """(number of the query, row id, score) of each query's k best rows but those of its id; ties go to the smaller row id."""
    (qid, q), (rid, r) = queries, rows
    d = q.shape[0]
    cuts = list(range(0, d, dims))
    tail = lambda v: np.sqrt(np.stack([(v[c:].astype(np.float64) ** 2).sum(axis=0) for c in [*cuts[1:], d]]))  # noqa: E731  norms of what remains after each block
    q_tail, r_tail = tail(q), tail(r)
    fq, fr = q.T.astype(np.float64), r.astype(np.float64)  # sums of products stay below 2**53, so these are exact
    exact = max(1.0, np.abs(fq).max(initial=0)) * max(1.0, np.abs(fr).max(initial=0)) * d < 2**53
    if not exact:
        fq, fr = q.T.astype(object), r.astype(object)
    order = np.argsort(rid, kind="stable")
    head = fq[:, : cuts[1] if len(cuts) > 1 else d] @ fr[: cuts[1] if len(cuts) > 1 else d]
    out = []
    for i in range(len(qid)):
        live = order[rid[order] != qid[i]]
        if not len(live):
            continue
        # a first threshold: exact scores of the k rows that lead after the first block of dimensions
        lead = live[np.argsort(-head[i, live].astype(np.float64), kind="stable")[:k]]
        least = np.sort((fq[i] @ fr[:, lead]).astype(np.float64))[0] if len(lead) == k else -np.inf
        sums = head[i, live]
        for b, c in enumerate(cuts):
            if b:
                sums = sums + fq[i, c : c + dims] @ fr[c : c + dims, live]
            if b < len(cuts) - 1:
                keep = sums.astype(np.float64) + q_tail[b, i] * r_tail[b, live] * (1 + 1e-9) + 1e-6 >= least
                live, sums = live[keep], sums[keep]
        top = np.lexsort((rid[live], -sums.astype(np.float64)))[:k] if exact else np.array(sorted(range(len(live)), key=lambda j: (-int(sums[j]), rid[live[j]]))[:k], dtype=int)
        out += [(i, int(rid[live[j]]), int(sums[j])) for j in top]
    return out


def top_k(df: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, scale: int = 256) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each row of ``queries`` the ``k`` rows of ``df`` with the largest integer
    inner product, itself (the same id) left out, ties to the smaller id; all, if there are fewer.

    Queries are dealt into groups and rows into parts of bounded size, and each group meets each part in a cell of its
    own: what travels is a row for each group and a query for each part, never a pair. A cell returns k rows a query,
    which are then merged in steps of bounded size. Rows are dealt by a hash of id and vector, so those equal in both meet in one cell. Rows without a usable vector or an id take no part. Rows of ``df`` that repeat an id all
    take part and may each be listed. Queries that share an id are ranked by themselves, each from 1; those that share
    the vector too are one. Vectors must have one length; another raises ValueError. No rows give no rows; other
    columns do not matter.
    """
    rows = quantised(df, id_col, vector_col, scale)
    asked = quantised(queries, id_col, vector_col, scale).distinct().withColumn("own", F.xxhash64("v"))
    parts, groups = (max(1, math.ceil(x.count() / size)) for x, size in ((rows, ROWS_A_CELL), (asked, QUERIES_A_CELL)))
    draw = lambda n: F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")  # noqa: E731  the same when a lost task is made again
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    r = rows.withColumn("s", draw(parts)).withColumn("g", every(groups))
    q = asked.withColumn("g", draw(groups)).withColumn("s", every(parts))

    def meet(key: tuple, asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(asked) and len(rows):
            widths = {len(v) for v in asked["v"]} | {len(v) for v in rows["v"]}
            if len(widths) != 1:
                raise ValueError("vectors differ in length")
            found = best(*[(x["id"].to_numpy(), np.stack(x["v"].to_numpy()).T.astype(np.int64)) for x in (asked, rows)], k)
            own = asked["own"].to_numpy()
            found = [(int(own[i]), int(asked["id"].iloc[i]), vec, score) for i, vec, score in found]
        return pd.DataFrame(found, columns=["own", "query_id", "vec_id", "score"], dtype="int64").assign(s=int(key[1]))

    met = q.groupBy("g", "s").cogroup(r.groupBy("g", "s")).applyInPandas(meet, "own long, query_id long, vec_id long, score long, s long")
    lists = met.select("query_id", "own", "s", F.array(F.struct((-F.col("score")).alias("s"), "vec_id")).alias("t"))
    while True:  # each step merges the leading rows of MERGED parts of a query, so no row grows with the table
        parts = math.ceil(parts / MERGED)
        lists = lists.groupBy("query_id", "own", F.floor(F.col("s") / MERGED).alias("s")).agg(F.slice(F.array_sort(F.flatten(F.collect_list("t"))), 1, k).alias("t"))
        if parts == 1:
            break
    top = lists.select("query_id", F.posexplode("t").alias("rank", "t"))
    return top.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("t.vec_id").alias("vec_id"), (-F.col("t.s")).alias("score"))
