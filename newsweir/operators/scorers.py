"""Methods that score shown and retrieve unshown articles, behind one interface."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators import bm25, vectors
from newsweir.operators.durable import stored
from newsweir.operators.skew import lookup


class Scorer(Protocol):
    """What a method must offer; a query stands for a list of recent articles.

    users(recent) makes the queries' representations from (dataset, query, recent); score(pairs, users)
    adds `score` to (query, article_id), a query that isn't known scores 0; top(users, k) gives (query,
    article_id, score, rank).
    """

    def users(self, recent: DataFrame) -> DataFrame: ...

    def score(self, pairs: DataFrame, users: DataFrame) -> DataFrame: ...

    def top(self, users: DataFrame, k: int) -> DataFrame: ...


class Lexical:
    """BM25 over the articles' titles and abstracts; a user is the terms of their recent titles."""

    def __init__(self, articles: DataFrame):
        self.articles = articles
        self.docs = stored(bm25.article_weights(bm25.term_weights(articles)))

    def users(self, recent: DataFrame) -> DataFrame:
        return stored(bm25.query_terms(recent, self.articles))

    def score(self, pairs: DataFrame, users: DataFrame) -> DataFrame:
        return bm25.candidate_scores(pairs, users, self.docs)

    def top(self, users: DataFrame, k: int) -> DataFrame:
        return bm25.top_articles(users, self.docs, k)


class Semantic:
    """Cosine of embeddings of `dims` numbers; a user is the mean of their recent articles' vectors."""

    def __init__(self, articles: DataFrame, dims: int = 64):
        self.dims = dims
        self.vectors = stored(vectors.article_vectors(articles, dims))

    def users(self, recent: DataFrame) -> DataFrame:
        return stored(vectors.query_vectors(recent, self.vectors, self.dims))

    def score(self, pairs: DataFrame, users: DataFrame) -> DataFrame:
        return vectors.candidate_cosines(pairs, users, self.vectors)

    def top(self, users: DataFrame, k: int) -> DataFrame:
        return vectors.top_articles(users, self.vectors, k)


class Popular:
    """The number of clicks in (article_id, n), the same for every user."""

    def __init__(self, counts: DataFrame, articles: DataFrame):
        self.counts = stored(counts.join(articles.select("dataset", "article_id"), "article_id"))

    def users(self, recent: DataFrame) -> DataFrame:
        return recent.select("dataset", "query")

    def score(self, pairs: DataFrame, users: DataFrame) -> DataFrame:
        known = lookup(pairs, self.counts.select("article_id", "n"), ["article_id"], "left")
        return known.withColumn("score", F.coalesce("n", F.lit(0)).cast("double")).drop("n")

    def top(self, users: DataFrame, k: int) -> DataFrame:
        """The same k articles for all users of a dataset, so they are found once: k rows a dataset are broadcast."""
        order = Window.partitionBy("dataset").orderBy(F.desc("n"), "article_id")
        best = self.counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        best = best.select("dataset", "article_id", F.col("n").cast("double").alias("score"), "rank")
        return users.join(F.broadcast(best), "dataset").select("query", "article_id", "score", "rank")
