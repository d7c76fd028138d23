"""Lexical retrieval: Okapi BM25 over titles and abstracts."""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.functions.text import terms, title_and_abstract
from newsweir.operators.blocks import top_lists
from newsweir.operators.skew import lookup

K1, B = 1.5, 0.75
PLACES = 6
# Of a block: terms in more than 1/_RARE of the articles get a dense column, up to _DENSE of them; places scored at once.
_RARE, _DENSE, _EXACT = 128, 1024, 1 << 14


def document_terms(articles: DataFrame) -> DataFrame:
    """(dataset, article_id, terms): all terms of an article with title and abstract, repeats kept."""
    return articles.select("dataset", "article_id", terms(title_and_abstract()).alias("terms"))


def term_weights(articles: DataFrame, k1: float = K1, b: float = B) -> DataFrame:
    """(dataset, term, article_id, tf, df, weight): what each term of an article adds to a query's score.

    A query counts a term once, so the weight is independent of the query: idf * tf * (k1 + 1) / (tf +
    k1 * (1 - b + b * length/average)), idf = ln((N - df + 0.5) / (df + 0.5) + 1), per dataset. Articles
    without terms count in N and the average.
    """
    docs = document_terms(articles)
    stats = docs.groupBy("dataset").agg(F.count(F.lit(1)).alias("_n"), F.avg(F.size("terms")).alias("_mean"))
    tf = (
        docs.select("dataset", "article_id", F.size("terms").alias("_length"), F.explode("terms").alias("term"))
        .groupBy("dataset", "article_id", "_length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )
    df = tf.groupBy("dataset", "term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.ln((F.col("_n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    norm = F.col("tf") + k1 * (1 - b + b * F.col("_length") / F.col("_mean"))
    # One row of statistics per dataset.
    joined = tf.join(F.broadcast(stats), "dataset").join(df, ["dataset", "term"])
    return joined.select("dataset", "term", "article_id", "tf", "df", (idf * F.col("tf") * (k1 + 1) / norm).alias("weight"))


def article_weights(weights: DataFrame) -> DataFrame:
    """(dataset, article_id, terms, weights): the weights of an article side by side."""
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    one = weights.groupBy("dataset", "article_id").agg(pairs.alias("_w"))
    return one.select("dataset", "article_id", F.col("_w.term").alias("terms"), F.col("_w.weight").alias("weights"))


def query_terms(recent: DataFrame, articles: DataFrame) -> DataFrame:
    """(dataset, query, terms): the distinct terms in the titles of each query's recent articles.

    `recent` has dataset, query and recent, an id list of bounded length. Missing titles are empty;
    queries without terms are left out.
    """
    titles = articles.select("article_id", terms(F.col("title")).alias("_terms"))
    long = recent.select("dataset", "query", F.explode("recent").alias("article_id"))
    all_terms = F.array_sort(F.array_distinct(F.flatten(F.collect_list("_terms"))))
    return lookup(long, titles, ["article_id"]).groupBy("dataset", "query").agg(all_terms.alias("terms")).filter(F.size("terms") > 0)


def candidate_scores(pairs: DataFrame, queries: DataFrame, docs: DataFrame) -> DataFrame:
    """`pairs` (query, article_id) with score: the weights of the article's terms that the query has, summed.

    The candidates come first: only their own terms are looked at, no postings are scanned. A query or an
    article that isn't known scores 0.
    """
    p = lookup(pairs, docs.select("article_id", F.arrays_zip("terms", "weights").alias("_doc")), ["article_id"], "left")
    p = lookup(p, queries.select("query", F.col("terms").alias("_query")), ["query"], "left")
    hits = F.filter("_doc", lambda x: F.array_contains("_query", x["terms"]))
    total = F.aggregate(hits, F.lit(0.0), lambda s, x: s + x["weights"])
    return p.withColumn("score", F.round(F.coalesce(total, F.lit(0.0)), PLACES)).drop("_doc", "_query")


class _Postings:
    """A block's weights: entries by article, and a column for each term that is asked for, frequent ones first and dense."""

    def __init__(self, vocabulary, table):
        self.n = table.num_rows
        lists = table["terms"].combine_chunks()
        codes = lists.flatten().dictionary_encode()
        known = pc.index_in(codes.dictionary, vocabulary).fill_null(-1).to_numpy()
        term = known[codes.indices.to_numpy()]
        doc = np.repeat(np.arange(self.n), np.diff(lists.offsets.to_numpy()))[term >= 0]
        self.weight = table["weights"].combine_chunks().flatten().to_numpy()[term >= 0]
        term = term[term >= 0]
        counts = np.bincount(term, minlength=len(vocabulary))
        order = np.argsort(-counts, kind="stable")
        self.column = np.full(len(vocabulary), -1)
        self.width = int((counts > 0).sum())
        self.column[order[: self.width]] = np.arange(self.width)
        self.dense = min(int((counts > self.n / _RARE).sum()), _DENSE)
        self.col = self.column[term]
        self.size = np.bincount(doc, minlength=self.n)
        self.start = np.cumsum(self.size) - self.size
        often = self.col < self.dense
        self.matrix = np.zeros((self.dense, self.n), np.float32)
        self.matrix[self.col[often], doc[often]] = self.weight[often]
        rare = np.flatnonzero(~often)
        rare = rare[np.argsort(self.col[rare], kind="stable")]
        self.rare_doc, self.rare_weight = doc[rare], self.weight[rare].astype(np.float32)
        self.rare_size = np.bincount(self.col[rare], minlength=self.width)
        self.rare_start = np.cumsum(self.rare_size) - self.rare_size


class _Sums:
    """Scores of top_lists: a frequent term is a column of a matrix product, others are added posting by posting."""

    least = 0.0

    def queries(self, table):
        lists = table["terms"].combine_chunks()
        codes = lists.flatten().dictionary_encode()
        return codes.dictionary, codes.indices.to_numpy(), np.r_[0, np.cumsum(np.diff(lists.offsets.to_numpy()))]

    def block(self, queries, table):
        return _Postings(queries[0], table)

    def near(self, queries, block, lo, hi):
        _, codes, ends = queries
        row, col = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1])), block.column[codes[ends[lo] : ends[hi]]]
        row, col = row[col >= 0], col[col >= 0]
        block.asked = np.zeros((hi - lo, block.width), bool)
        block.asked[row, col] = True
        near = block.asked[:, : block.dense].astype(np.float32) @ block.matrix
        row, col = row[col >= block.dense], col[col >= block.dense]
        at, size = _spans(block.rare_start[col], block.rare_size[col])
        np.add.at(near.reshape(-1), np.repeat(row, size) * block.n + block.rare_doc[at], block.rare_weight[at])
        return near

    def exact(self, queries, block, lo, row, col):
        out = np.empty(len(row))
        for i in range(0, len(row), _EXACT):
            r, c = row[i : i + _EXACT], col[i : i + _EXACT]
            at, size = _spans(block.start[c], block.size[c])
            worth = block.weight[at] * block.asked[np.repeat(r, size), block.col[at]]
            out[i : i + _EXACT] = np.add.reduceat(worth, np.cumsum(size) - size)
        return out

    def floor(self, block, x):
        """Weights are above 0, so a sum of n of them in single precision is off by a share of n / 2^23 at most."""
        return (x - 10.0**-PLACES) * (1 - (block.width + 8) / 2**23)


def _spans(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of spans laid end to end, and their sizes."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum()), size


def top_articles(queries: DataFrame, docs: DataFrame, k: int = 200) -> DataFrame:
    """(query, article_id, score, rank): the k articles of a query's dataset with the highest scores.

    Only articles that share a term with the query; equal scores, to 6 places, are ordered by id.
    """
    items = docs.select(F.col("dataset").alias("realm"), F.col("article_id").alias("id"), "terms", "weights")
    asks = queries.select(F.col("dataset").alias("realm"), F.col("query").alias("id"), "terms")
    return top_lists(items, asks, k, _Sums()).withColumnRenamed("item", "article_id")
