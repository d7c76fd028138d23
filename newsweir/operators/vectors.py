"""Semantic retrieval: mean-pooled user vectors and exact cosine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.beside import beside, coded
from newsweir.operators.blocks import top_lists
from newsweir.operators.skew import lookup

PLACES = 6
_EXACT = 1 << 14  # places scored at once


def article_vectors(articles: DataFrame, dims: int = 64) -> DataFrame:
    """(dataset, article_id, vector): embeddings of `dims` numbers, none of them null."""
    whole = (F.size("embedding") == dims) & ~F.exists("embedding", lambda x: x.isNull())
    return articles.filter(whole).select("dataset", "article_id", F.col("embedding").alias("vector"))


def query_vectors(recent: DataFrame, vectors: DataFrame, dims: int = 64) -> DataFrame:
    """(dataset, query, vector): the mean of the vectors of each query's recent articles, in doubles.

    Articles that occur twice weigh twice, those without vector are skipped; queries left without any
    have no row.
    """
    long = recent.select("dataset", "query", F.explode("recent").alias("article_id"))
    known = lookup(long, vectors.select("article_id", "vector"), ["article_id"])
    means = known.groupBy("dataset", "query").agg(*[F.avg(F.col("vector")[i].cast("double")).alias(f"_{i}") for i in range(dims)])
    return means.select("dataset", "query", F.array(*[f"_{i}" for i in range(dims)]).alias("vector"))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def candidate_cosines(pairs: DataFrame, queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """`pairs` (query, article_id) with score, the cosine; 0 where either vector is missing or zero."""
    unit = vectors.select("article_id", F.col("vector").alias("_a"), F.greatest(F.sqrt(dot(F.col("vector"), F.col("vector"))), F.lit(1e-9)).alias("_an"))
    q = queries.select("query", F.col("vector").alias("_q"), F.greatest(F.sqrt(dot(F.col("vector"), F.col("vector"))), F.lit(1e-9)).alias("_qn"))
    p = lookup(lookup(pairs, unit, ["article_id"], "left"), q, ["query"], "left")
    cosine = dot(F.col("_a"), F.col("_q")) / (F.col("_an") * F.col("_qn"))
    return p.withColumn("score", F.round(F.coalesce(cosine, F.lit(0.0)), PLACES)).drop("_a", "_an", "_q", "_qn")


def _unit(table) -> np.ndarray:
    lists = table["v"].combine_chunks()
    x = lists.flatten().to_numpy().reshape(table.num_rows, -1)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n == 0, 1, n)


class _Cosines:
    """Scores of top_lists: products of unit vectors, nearly in single precision."""

    least = -np.inf

    def queries(self, table):
        unit = _unit(table)
        return unit, unit.astype(np.float32)

    def block(self, queries, table):
        unit = _unit(table)
        return unit, unit.astype(np.float32).T, np.flatnonzero(~np.isfinite(unit).all(axis=1))

    def near(self, queries, block, lo, hi):
        near = queries[1][lo:hi] @ block[1]
        near[:, block[2]] = -np.inf
        return near

    def exact(self, queries, block, lo, row, col):
        out = np.empty(len(row))
        for i in range(0, len(row), _EXACT):
            out[i : i + _EXACT] = np.einsum("ij,ij->i", queries[0][lo + row[i : i + _EXACT]], block[0][col[i : i + _EXACT]])
        return out

    def floor(self, block, x):
        """A product of unit vectors in single precision is off by its length / 2^23 at most."""
        return x - 10.0**-PLACES - (block[0].shape[1] + 8) / 2**23


def top_articles(queries: DataFrame, vectors: DataFrame, k: int = 200) -> DataFrame:
    """(query, article_id, score, rank): the k articles of a query's dataset with the highest cosine.

    Always min(k, all) rows, negative ones included; equal cosines, to 6 places, are ordered by id.
    """
    items = vectors.select(F.col("dataset").alias("realm"), F.col("article_id").alias("id"), F.col("vector").cast("array<double>").alias("v"))
    asks = queries.select(F.col("dataset").alias("realm"), F.col("query").alias("id"), F.col("vector").alias("v"))
    return top_lists(items, asks, k, _Cosines()).withColumnRenamed("item", "article_id")


def reranked(pairs: DataFrame, queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(query, article_id, score, rank): the k of each query's `pairs` with the highest cosine, as candidate_cosines has it; ties by id.

    `pairs` stay where they are: of a query's pairs in a chunk only those go on that may be among its first.
    """

    def lengths(x: np.ndarray) -> np.ndarray:
        return np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x)), 1e-9)

    def work(chunks):
        for rows, *found in chunks:
            cosine = np.zeros(rows.num_rows)
            (q, asks), (a, items) = found
            some = np.flatnonzero((q >= 0) & (a >= 0))
            if len(some):
                x, y = (t["vector"].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t in (asks, items))
                for i in range(0, len(some), _EXACT):
                    at = some[i : i + _EXACT]
                    u, w = x[q[at]], y[a[at]].astype(float)
                    cosine[at] = np.einsum("ij,ij->i", u, w) / (lengths(u) * lengths(w))
            code, _ = coded(rows, "query")
            worth = np.where(np.isnan(cosine), np.inf, cosine)
            order = np.lexsort((-worth, code))
            n = np.bincount(code)
            last = worth[order[np.cumsum(n) - n + np.minimum(n, k) - 1]]
            keep = pa.array(np.flatnonzero(worth >= last[code] - 2 * 10.0**-PLACES))
            yield pa.RecordBatch.from_arrays([rows["query"].combine_chunks().take(keep), rows["article_id"].combine_chunks().take(keep), pa.array(cosine).take(keep)], ["query", "article_id", "score"])

    smalls = [(queries.select("query", "vector"), "query"), (vectors.select("article_id", "vector"), "article_id")]
    found = beside(pairs.select("query", "article_id"), smalls, work, "query string, article_id string, score double")
    found = found.withColumn("score", F.round("score", PLACES))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "article_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)
