import math

import numpy as np
from pyspark.sql import functions as F

from newsweir.functions.text import terms, title_and_abstract
from newsweir.operators import bm25, vectors
from newsweir.operators.metrics import recall_at

A = "dataset string, article_id string, title string, abstract string"


def test_terms(spark):
    rows = [("Prince Harry's DNA-test!",), (None,), ("",), ("x²½ a1b_c Ærø",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(terms(F.col("t"))).collect()]
    assert got == [["prince", "harry", "s", "dna", "test"], [], [], ["x²½", "a", "b", "c", "ærø"]]


def test_corpus(spark):
    df = spark.createDataFrame([("Hello", None), (None, "World")], "title string, abstract string")
    assert [r[0] for r in df.select(title_and_abstract()).collect()] == ["Hello ", " World"]


def index(spark, docs):
    w = bm25.term_weights(spark.createDataFrame([("d", i, t, a) for i, t, a in docs], A))
    return w, bm25.article_weights(w)


DOCS = [("a", "ice hockey", "goal in the ice match"), ("b", "stock market", "goal"), ("c", "cooking", "soup"), ("e", None, None)]


def brute(query, docs, k1=1.5, b=0.75):
    texts = {i: f"{t or ''} {a or ''}".split() for i, t, a in docs}
    mean, n = sum(map(len, texts.values())) / len(texts), len(texts)
    out = {}
    for i, words in texts.items():
        s = 0.0
        for term in set(query.split()):
            df, tf = sum(term in w for w in texts.values()), words.count(term)
            if tf:
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(words) / mean))
        out[i] = round(s, 6)
    return out


def test_bm25_scores(spark):
    w, docs = index(spark, DOCS)
    q = spark.createDataFrame([("d", "q", ["ice", "hockey", "goal"])], "dataset string, query string, terms array<string>")
    want = brute("ice hockey goal", DOCS)
    got = [(r["article_id"], r["score"], r["rank"]) for r in bm25.top_articles(q, docs, 5).orderBy("rank").collect()]
    assert got == [("a", want["a"], 1), ("b", want["b"], 2)]
    assert bm25.top_articles(q, docs, 1).count() == 1
    pairs = spark.createDataFrame([("q", "c"), ("q", "a"), ("q", "unknown"), ("q", "a"), ("none", "a")], "query string, article_id string")
    scored = [(r["query"], r["article_id"], r["score"]) for r in bm25.candidate_scores(pairs, q, docs).collect()]
    assert sorted(scored) == sorted([("q", "c", 0.0), ("q", "a", want["a"]), ("q", "unknown", 0.0), ("q", "a", want["a"]), ("none", "a", 0.0)])


def test_queries_come_from_known_titles(spark):
    articles = spark.createDataFrame([("d", i, t, a) for i, t, a in DOCS], A)
    recent = spark.createDataFrame([("d", "q", ["a", "b", "gone"]), ("d", "empty", ["e"])], "dataset string, query string, recent array<string>")
    got = {r["query"]: r["terms"] for r in bm25.query_terms(recent, articles).collect()}
    assert got == {"q": ["hockey", "ice", "market", "stock"]}


def test_cap_and_ties_by_id(spark):
    docs = [(f"n{i:02d}", "same words", None) for i in range(20)]
    _, d = index(spark, docs)
    q = spark.createDataFrame([("d", "q", ["same"])], "dataset string, query string, terms array<string>")
    got = [r["article_id"] for r in bm25.top_articles(q, d, 5).orderBy("rank").collect()]
    assert got == [f"n{i:02d}" for i in range(5)]


V = "dataset string, article_id string, embedding array<float>"


def test_user_vectors(spark):
    v = vectors.article_vectors(spark.createDataFrame([("d", "a", [1.0, 0.0]), ("d", "b", [0.0, 1.0]), ("d", "c", [2.0]), ("d", "n", None)], V), 2)
    recent = spark.createDataFrame([("d", "ab", ["a", "b"]), ("d", "aab", ["a", "a", "b"]), ("d", "ax", ["a", "x"]), ("d", "none", ["c", "n"])], "dataset string, query string, recent array<string>")
    got = {r["query"]: [round(x, 9) for x in r["vector"]] for r in vectors.query_vectors(recent, v, 2).collect()}
    assert got == {"ab": [0.5, 0.5], "aab": [round(2 / 3, 9), round(1 / 3, 9)], "ax": [1.0, 0.0]}


def test_cosines(spark):
    v = vectors.article_vectors(spark.createDataFrame([("d", "a", [1.0, 0.0]), ("d", "b", [0.0, 1.0]), ("d", "c", [-1.0, 0.0]), ("d", "z", [0.0, 0.0])], V), 2)
    q = spark.createDataFrame([("d", "u", [1.0, 0.0])], "dataset string, query string, vector array<double>")
    pairs = spark.createDataFrame([("u", x) for x in ["a", "b", "c", "missing", "z"]] + [("nobody", "a")], "query string, article_id string")
    got = {(r["query"], r["article_id"]): r["score"] for r in vectors.candidate_cosines(pairs, q, v).collect()}
    assert got == {("u", "a"): 1.0, ("u", "b"): 0.0, ("u", "c"): -1.0, ("u", "missing"): 0.0, ("u", "z"): 0.0, ("nobody", "a"): 0.0}


def test_exact_top(spark):
    eye = np.eye(3).tolist()
    v = vectors.article_vectors(spark.createDataFrame([("d", f"x{i}", e) for i, e in enumerate(eye)], V), 3)
    q = spark.createDataFrame([("d", "u", [0.9, 0.1, 0.0])], "dataset string, query string, vector array<double>")
    got = [r["article_id"] for r in vectors.top_articles(q, v, 100).orderBy("rank").collect()]
    assert got == ["x0", "x1", "x2"]


def test_blocks_give_what_one_matrix_gives(spark, monkeypatch):
    import newsweir.operators.blocks as blocks

    monkeypatch.setattr(blocks, "_BLOCK", 16)
    monkeypatch.setattr(blocks, "_SHARE", 8)
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((100, 5)).astype(np.float32), rng.standard_normal((30, 5))
    v = vectors.article_vectors(spark.createDataFrame([("d", f"a{i:03d}", r.tolist()) for i, r in enumerate(x)], V), 5)
    q = spark.createDataFrame([("d", f"q{i}", r.tolist()) for i, r in enumerate(y)], "dataset string, query string, vector array<double>")
    got = {(r["query"], r["rank"]): r["article_id"] for r in vectors.top_articles(q, v, 7).collect()}
    s = np.round((y / np.linalg.norm(y, axis=1)[:, None]) @ (x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]).T, 6)
    want = {(f"q{i}", k + 1): f"a{j:03d}" for i, row in enumerate(s) for k, j in enumerate(np.argsort(-row, kind="stable")[:7])}
    assert got == want


def test_vector_lists_are_not_shuffled(spark):
    v = vectors.article_vectors(spark.createDataFrame([("d", f"x{i}", e) for i, e in enumerate(np.eye(3).tolist())], V), 3)
    top = vectors.top_articles(spark.createDataFrame([("d", "u", [0.9, 0.1, 0.0]), ("d", "bad", [float("nan")] * 3)], "dataset string, query string, vector array<double>"), v, 2)
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    assert [(r["query"], r["article_id"], r["rank"]) for r in top.orderBy("rank").collect()] == [("u", "x0", 1), ("u", "x1", 2)]


def test_recall(spark):
    top = spark.createDataFrame([("q", x, i + 1) for i, x in enumerate("abcde")], "query string, article_id string, rank int")
    clicked = [("1", "q", "a"), ("2", "q", "z"), ("3", "q", "a"), ("3", "q", "z"), ("4", "q", "d"), ("5", "cold", "a")]
    c = spark.createDataFrame(clicked, "impression_id string, query string, article_id string")
    got = {r["impression_id"]: (r["recall_3"], r["recall_5"]) for r in recall_at(c, top, ["impression_id"], "query", [3, 5]).collect()}
    assert got == {"1": (1, 1), "2": (0, 0), "3": (0.5, 0.5), "4": (0, 1), "5": (0, 0)}


def test_lists_of_many_blocks_are_neither_shuffled_nor_cut(spark, monkeypatch):
    import newsweir.operators.blocks as blocks

    monkeypatch.setattr(blocks, "_BLOCK", 8)
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}" for i in range(25)]
    docs = [(f"n{i:03d}", " ".join(rng.choice(words, rng.integers(1, 9))), None) for i in range(100)] + [(f"s{i:02d}", "wb wc", None) for i in range(40)]
    _, d = index(spark, docs)
    asks = {f"q{i}": " ".join(sorted(rng.choice(words, 4, replace=False))) for i in range(20)} | {"tied": "wb wc", "none": "other"}
    q = spark.createDataFrame([("d", i, t.split()) for i, t in asks.items()], "dataset string, query string, terms array<string>")
    top = bm25.top_articles(q, d, 6)
    assert "Window" not in top._jdf.queryExecution().executedPlan().toString()
    got = {(r["query"], r["rank"]): (r["article_id"], r["score"]) for r in top.collect()}
    want = {}
    for i, t in asks.items():
        best = sorted(((-s, a) for a, s in brute(t, docs).items() if s > 0))[:6]
        want |= {(i, k + 1): (a, -s) for k, (s, a) in enumerate(best)}
    assert got == want
