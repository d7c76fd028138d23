"""Queries of the llm operators with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsweir.functions.text import title_and_abstract
from newsweir.llm.distinctive import distinctive_terms
from newsweir.llm.frequent import frequent_items, misra_gries
from newsweir.llm.fusion import fused_ranking, majority_items
from newsweir.llm.mixing import mix, source_name
from newsweir.llm.packing import pack
from newsweir.llm.personal import find_personal, redact_personal
from newsweir.llm.similar import class_links, measured_recall, nearest, similar_classes, similar_pairs
from newsweir.llm.together import together
from newsweir.llm.tokens import with_tokens
from newsweir.operators.durable import stored
from newsweir.sources.tables import clean_ids, clicks, table

FREQUENT_SHARE = 0.01
DIMS = 64


def nearest_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 most similar articles of every article with a usable embedding."""
    articles = table(spark, sf_dir, "articles").select("article_id", "embedding")
    return nearest(articles, "article_id", "embedding", DIMS, 10).withColumnsRenamed({"item": "article_id", "neighbour": "similar_id"})


def similar_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles").select("article_id", "embedding")
    return similar_pairs(articles, "article_id", "embedding", DIMS, 0.9).withColumnsRenamed({"a": "article_id_a", "b": "article_id_b"})


def article_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every article with a usable embedding, the class of its copies and how many classes are linked to that."""
    articles = table(spark, sf_dir, "articles").select("article_id", "embedding")
    found = class_links(*similar_classes(articles, "article_id", "embedding", DIMS, 0.9))
    return found.select(F.col("item").alias("article_id"), F.col("class").alias("class_id"), "links")


def nearest_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the 10 most similar articles against brute force, for the articles whose number is divisible by 20."""
    articles = table(spark, sf_dir, "articles").select("article_id", "embedding")
    asked = F.regexp_extract("item", r"(\d+)$", 1).cast("long") % 20 == 0
    found = measured_recall(articles, "article_id", "embedding", DIMS, 10, asked)
    return found.select("queries", (F.col("recall") >= 0.9).alias("recall_of_at_least_09"))


def term_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    articles = table(spark, sf_dir, "articles")
    return distinctive_terms(articles, "article_id", title_and_abstract())


def rare_repeated_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of the mixture's rows that hold the exact bounds of the case, whatever their posterior: where one
    record repeats a term heavily, the mixture takes the other holders for the base component."""
    found = term_scores(spark, sf_dir)
    return found.filter((F.col("tf") >= 3) & F.col("df").between(2, 6)).select("article_id", "term")


def reading_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(record, article_id): each user's history over all rows, and each impression's clicks."""
    history = table(spark, sf_dir, "user_history").filter(F.col("user_id").isNotNull())
    read = history.select(F.concat(F.lit("u"), "user_id").alias("record"), F.explode(clean_ids("history_article_ids")).alias("article_id"))
    imp = table(spark, sf_dir, "impressions").filter(F.col("impression_id").isNotNull())
    clicked = imp.select(F.concat(F.lit("i"), "impression_id").alias("record"), F.explode(clean_ids("clicked")).alias("article_id"))
    return read.unionByName(clicked)


def article_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of articles read or clicked together, with lift, tail probability and surprise."""
    return together(reading_records(spark, sf_dir), "record", "article_id", rate=0.05).withColumnsRenamed(
        {"a": "article_id_a", "b": "article_id_b"}
    )


def surprising_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that are surprising at a false-discovery rate of 5 % under the fitted null, within the case's exact bounds."""
    pairs = together(reading_records(spark, sf_dir), "record", "article_id", min_count=5, min_lift=30.0, rate=0.05)
    found = pairs.filter(F.col("surprising") & (F.col("n") >= 5) & (F.col("lift") >= 30.0 - 1e-9))
    return found.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"))


def most_clicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles with over 1/1001 of all clicks, among others, with bounds of their number of clicks."""
    found = misra_gries(clicks(table(spark, sf_dir, "impressions")), "article_id", 1000)
    return found.withColumnsRenamed({"item": "article_id", "low": "clicks_low", "high": "clicks_high", "total": "all_clicks"})


def heavily_clicked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = frequent_items(clicks(table(spark, sf_dir, "impressions")), "article_id", FREQUENT_SHARE)
    return found.select(F.col("item").alias("article_id"))


def fused_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scored articles of each impression in one order."""
    c = table(spark, sf_dir, "candidates")
    return fused_ranking(c, "impression_id", "method", "retrieved_article_ids", "retrieved_scores").withColumnsRenamed(
        {"record": "impression_id", "item": "article_id"}
    )


def fused_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of clicks in the top 1, 5 and 10 and mean reciprocal rank of the first click, fused and by method.

    Over the impressions in candidates with a click; a click that no method retrieved is a miss.
    """
    fused = fused_candidates(spark, sf_dir).select("impression_id", F.lit("fused").alias("ranking"), "article_id", "rank")
    c = table(spark, sf_dir, "candidates").filter(F.col("method").isNotNull()).distinct()
    alone = fused_ranking(
        c.withColumn("impression_id", F.concat_ws("\t", "impression_id", "method")),
        "impression_id",
        "method",
        "retrieved_article_ids",
        "retrieved_scores",
    )
    alone = alone.select(
        F.substring_index("record", "\t", 1).alias("impression_id"),
        F.substring_index("record", "\t", -1).alias("ranking"),
        F.col("item").alias("article_id"),
        "rank",
    )
    shown = table(spark, sf_dir, "candidates").select("impression_id").distinct()
    clicked = clicks(table(spark, sf_dir, "impressions")).join(shown, "impression_id", "left_semi")
    hits = clicked.join(fused.unionByName(alone), ["impression_id", "article_id"])
    hits = hits.groupBy("impression_id", "ranking").agg(
        F.min("rank").alias("first"), *[F.sum((F.col("rank") <= k).cast("int")).alias(f"in_{k}") for k in (1, 5, 10)]
    )
    n = clicked.groupBy("impression_id").agg(F.count(F.lit(1)).alias("clicks"))
    totals = n.agg(F.count(F.lit(1)), F.sum("clicks")).first()
    impressions, all_clicks = totals[0], totals[1] or 0
    return hits.groupBy("ranking").agg(
        F.round(F.sum(1 / F.col("first")) / impressions, 6).alias("mrr"),
        *[F.round(F.sum(f"in_{k}") / all_clicks, 6).alias(f"click_share_at_{k}") for k in (1, 5, 10)],
    )


def majority_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "candidates")
    found = majority_items(c, "impression_id", "method", "retrieved_article_ids", "retrieved_scores").filter(F.col("methods") >= 2)
    return found.select(F.col("record").alias("impression_id"), F.col("item").alias("article_id"))


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in containers of each of pack_specs' capacities."""
    specs = {r["spec_name"]: r["capacity_tokens"] for r in table(spark, sf_dir, "pack_specs").collect()}
    sized = stored(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text"))
    return pack(sized, "doc_id", "tokens", specs).withColumnsRenamed({"spec": "spec_name"})


def packing_room(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are."""
    specs = table(spark, sf_dir, "pack_specs")
    packed = packed_documents(spark, sf_dir)
    per = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("n"), F.count(F.lit(1)).alias("pieces"))
    per = per.groupBy("spec_name").agg(
        F.count_if(F.col("n") > 0).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("n").alias("tokens"), F.max("n").alias("fullest")
    )
    return per.join(specs, "spec_name").select(
        "spec_name", "containers", "pieces", "tokens", "fullest", F.round(F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("filled")
    )


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(with_tokens(table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "doc_kind", "text"), "text"))


def _mix(spark: SparkSession, sf_dir: str, total: str, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    return mix(
        sized or _sized(spark, sf_dir),
        table(spark, sf_dir, "mix_targets"),
        doc="doc_id",
        source="source",
        domain=F.col("doc_kind"),
        language="lang",
        size="tokens",
        total=total,
    )


def mixed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of each mix with their copies; each source present has its share."""
    return _mix(spark, sf_dir, "exact")[0]


def mixed_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, "exact")[1]


def mixed_documents_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As mixed_documents, in mixes as large as their sources; what small sources lack is redistributed."""
    return _mix(spark, sf_dir, "all")[0]


def mixed_shares_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir, "all")[1]


def frequent_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles with over 1/1001 of all clicks that most_clicked has, with a true count within its bounds."""
    n = clicks(table(spark, sf_dir, "impressions")).groupBy("article_id").agg(F.count(F.lit(1)).alias("clicks"))
    found = most_clicked(spark, sf_dir).join(n, "article_id")
    found = found.filter(F.col("clicks").between(F.col("clicks_low"), F.col("clicks_high")) & (F.col("clicks") * 1001 > F.col("all_clicks")))
    return found.select("article_id", "clicks")


def term_counts_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts behind the term scores, of rows whose score and posterior are proper numbers."""
    found = term_scores(spark, sf_dir).filter((F.col("score") >= 0) & F.col("p_elite").between(0, 1))
    return found.select("article_id", "term", "tf", "df")


def pair_lifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of at least 3 common records with their counts and lift, of those whose tail probability is one."""
    found = together(reading_records(spark, sf_dir), "record", "article_id", min_count=3).filter((F.col("log10_p") <= 0) & (F.col("expected") > 0))
    return found.select(F.col("a").alias("article_id_a"), F.col("b").alias("article_id_b"), "n", "n_a", "n_b", F.round("lift", 6).alias("lift"))


def fused_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored articles and methods of each impression, of those that are ranked from 1 to their number by scores that fall."""
    ranked = fused_candidates(spark, sf_dir)
    lists = ranked.groupBy("impression_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score"))).alias("_l"), F.max("methods").cast("long").alias("methods"))
    n, scores = F.size("_l"), F.col("_l.score")
    fair = (F.col("_l.rank") == F.sequence(F.lit(1), n)) & (F.reverse(F.array_sort(scores)) == scores)
    return lists.filter(fair).select("impression_id", n.cast("long").alias("items"), "methods")


def packing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents placed by each spec, how many of them were cut, and containers that hold more than they can."""
    packed = packed_documents(spark, sf_dir)
    specs = table(spark, sf_dir, "pack_specs").select("spec_name", "capacity_tokens")
    over = packed.groupBy("spec_name", "container").agg(F.sum("tokens").alias("n")).join(specs, "spec_name")
    over = over.groupBy("spec_name").agg(F.count_if(F.col("n") > F.col("capacity_tokens")).alias("overfull"))
    docs = packed.groupBy("spec_name", "doc_id").agg(F.count(F.lit(1)).alias("pieces"), F.count_distinct("part").alias("parts"), F.sum("tokens").alias("n")).join(specs, "spec_name")
    needless = (F.col("pieces") != F.col("parts")) | (F.col("pieces") != F.greatest(F.ceil(F.col("n") / F.col("capacity_tokens")), F.lit(1)))
    docs = docs.groupBy("spec_name").agg(F.count(F.lit(1)).alias("documents"), F.count_if(needless).alias("cut_needlessly"))
    return docs.join(over, "spec_name")


def mixing_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each source of each mix, as large as exact shares allow, is off its planned share by less than the
    largest document of the mix's sources, and has no more copies than allowed."""
    sized = _sized(spark, sf_dir)
    targets = table(spark, sf_dir, "mix_targets").select("mix_name", source_name(F.col("source")).alias("source"), "max_repeats")
    longest = sized.groupBy(source_name(F.col("source")).alias("source")).agg(F.max("tokens").alias("longest"))
    longest = targets.join(longest, "source").groupBy("mix_name").agg(F.max("longest").alias("longest"))
    rows = _mix(spark, sf_dir, "exact", sized)[1].join(targets, ["mix_name", "source"]).join(longest, "mix_name", "left")
    whole = F.sum("tokens").over(Window.partitionBy("mix_name"))
    near = F.abs(F.col("tokens") - F.col("planned_share") * whole) <= F.coalesce("longest", F.lit(0))
    return rows.select("mix_name", "source", near.alias("as_planned"), (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"))


def redaction_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come out redacted, and null texts that stay null."""
    out = redacted_documents(spark, sf_dir)
    return out.agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("text").isNull()).alias("null_texts"))


def personal_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list"))


def redacted_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with placeholders for personal information."""
    return redact_personal(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "name_list"))


QUERIES = {
    "p2_nearest": nearest_articles,
    "p2_found": similar_articles,
    "p2_classes": article_classes,
    "p2_recall": nearest_recall,
    "p3_term_scores": term_scores,
    "p3_found": rare_repeated_terms,
    "p3_term_counts": term_counts_scored,
    "p4_article_pairs": article_pairs,
    "p4_found": surprising_pairs,
    "p4_pair_lifts": pair_lifts,
    "p5_most_clicked": most_clicked,
    "p5_found": heavily_clicked,
    "p5_bounds": frequent_bounds,
    "p7_fused_ranking": fused_candidates,
    "p7_fused_quality": fused_quality,
    "p7_found": majority_articles,
    "p7_sizes": fused_sizes,
    "p8_packed": packed_documents,
    "p8_room": packing_room,
    "p8_bounds": packing_bounds,
    "p9_mixed": mixed_documents,
    "p9_shares": mixed_shares,
    "p9_mixed_all": mixed_documents_all,
    "p9_shares_all": mixed_shares_all,
    "p9_bounds": mixing_bounds,
    "p10_found": personal_information,
    "p10_redacted": redacted_documents,
    "p10_redacted_counts": redaction_counts,
}

_CLICKS = """clicks AS (SELECT DISTINCT impression_id, article_id
    FROM (SELECT impression_id, unnest(clicked) AS article_id FROM impressions)
    WHERE impression_id IS NOT NULL AND length(trim(article_id)) > 0)"""

_VECTORS = """v AS (SELECT article_id, max(embedding)::DOUBLE[] AS v FROM articles
            WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY article_id)"""

ORACLE = {
    "p2_classes": f"""WITH {_VECTORS}, c AS (SELECT v, min(article_id) AS class_id FROM v GROUP BY v),
        n AS (SELECT x.class_id, count(*) AS links FROM c x JOIN c y ON x.class_id <> y.class_id AND list_cosine_similarity(x.v, y.v) >= 0.9 GROUP BY ALL)
        SELECT article_id, class_id, coalesce(links, 0) AS links FROM v JOIN c USING (v) LEFT JOIN n USING (class_id)""",
    "p2_recall": f"""WITH {_VECTORS} SELECT count(*) AS queries, true AS recall_of_at_least_09 FROM v
        WHERE regexp_extract(article_id, '[0-9]+$')::BIGINT % 20 = 0""",
    "p2_found": """WITH v AS (SELECT article_id, max(embedding)::DOUBLE[] AS v FROM articles
            WHERE len(embedding) = 64 AND list_max(list_transform(embedding, lambda x: abs(x))) > 0 GROUP BY article_id)
        SELECT x.article_id AS article_id_a, y.article_id AS article_id_b FROM v x JOIN v y ON x.article_id < y.article_id
        WHERE list_cosine_similarity(x.v, y.v) >= 0.9""",
    "p3_found": r"""WITH one AS (SELECT DISTINCT article_id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text
            FROM articles WHERE article_id IS NOT NULL),
        long AS (SELECT article_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS term FROM one),
        tf AS (SELECT article_id, term, count(*) AS tf FROM long GROUP BY ALL),
        df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
        SELECT article_id, term FROM tf JOIN df USING (term) WHERE tf >= 3 AND df BETWEEN 2 AND 6""",
    "p4_found": f"""WITH {_CLICKS},
        m AS (SELECT DISTINCT * FROM (
            SELECT 'u' || user_id AS record, unnest(history_article_ids) AS item FROM user_history
            UNION ALL SELECT 'i' || impression_id, article_id FROM clicks)
            WHERE record IS NOT NULL AND length(trim(item)) > 0),
        f AS (SELECT item, count(*) AS n FROM m GROUP BY item),
        p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM m x JOIN m y ON x.record = y.record AND x.item < y.item
            GROUP BY ALL HAVING count(*) >= 5)
        SELECT a AS article_id_a, b AS article_id_b FROM p JOIN f fa ON fa.item = a JOIN f fb ON fb.item = b
        WHERE p.n * (SELECT count(DISTINCT record) FROM m) >= 30 * fa.n * fb.n""",
    "p3_term_counts": r"""WITH one AS (SELECT DISTINCT article_id, coalesce(title, '') || ' ' || coalesce(abstract, '') AS text
            FROM articles WHERE article_id IS NOT NULL),
        long AS (SELECT article_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{Nl}\p{No}]+')) AS term FROM one),
        tf AS (SELECT article_id, term, count(*) AS tf FROM long GROUP BY ALL)
        SELECT article_id, term, tf, count(*) OVER (PARTITION BY term) AS df FROM tf""",
    "p4_pair_lifts": f"""WITH {_CLICKS},
        m AS (SELECT DISTINCT * FROM (
            SELECT 'u' || user_id AS record, unnest(history_article_ids) AS item FROM user_history
            UNION ALL SELECT 'i' || impression_id, article_id FROM clicks)
            WHERE record IS NOT NULL AND length(trim(item)) > 0),
        f AS (SELECT item, count(*) AS n FROM m GROUP BY item),
        p AS (SELECT x.item AS a, y.item AS b, count(*) AS n FROM m x JOIN m y ON x.record = y.record AND x.item < y.item
            GROUP BY ALL HAVING count(*) >= 3)
        SELECT a AS article_id_a, b AS article_id_b, p.n, fa.n AS n_a, fb.n AS n_b,
            round(p.n * (SELECT count(DISTINCT record) FROM m)::DOUBLE / (fa.n * fb.n), 6) AS lift
        FROM p JOIN f fa ON fa.item = a JOIN f fb ON fb.item = b""",
    "p5_bounds": f"""WITH {_CLICKS}, n AS (SELECT article_id, count(*) AS clicks FROM clicks GROUP BY article_id)
        SELECT article_id, clicks FROM n WHERE clicks * 1001 > (SELECT count(*) FROM clicks)""",
    "p7_sizes": """WITH rows AS (SELECT impression_id, method, unnest(retrieved_article_ids) AS item, unnest(retrieved_scores) AS score
            FROM candidates WHERE impression_id IS NOT NULL AND method IS NOT NULL)
        SELECT impression_id, count(DISTINCT item) AS items, any_value(m.methods) AS methods FROM rows
        JOIN (SELECT impression_id, count(DISTINCT method) AS methods FROM candidates WHERE method IS NOT NULL GROUP BY 1) m USING (impression_id)
        WHERE length(trim(item)) > 0 AND score IS NOT NULL GROUP BY impression_id""",
    "p8_bounds": "SELECT spec_name, (SELECT count(*) FROM documents) AS documents, 0::BIGINT AS cut_needlessly, 0::BIGINT AS overfull FROM pack_specs",
    "p9_bounds": r"""SELECT mix_name, regexp_replace(lower(trim(source)), '[_\s]+', '-', 'g') AS source, true AS as_planned, true AS within_repeats
        FROM mix_targets""",
    "p10_redacted_counts": "SELECT count(*) AS documents, count_if(text IS NULL)::BIGINT AS null_texts FROM documents",
    "p5_found": f"""WITH {_CLICKS}, n AS (SELECT article_id, count(*) AS n FROM clicks GROUP BY article_id)
        SELECT article_id FROM n WHERE n >= 0.01 * (SELECT count(*) FROM clicks)""",
    "p7_found": """WITH rows AS (SELECT impression_id, method, unnest(retrieved_article_ids) AS item,
            unnest(retrieved_scores) AS score FROM candidates WHERE impression_id IS NOT NULL AND method IS NOT NULL),
        s AS (SELECT impression_id, method, item, max(score) AS score FROM rows
            WHERE length(trim(item)) > 0 AND score IS NOT NULL GROUP BY ALL),
        methods AS (SELECT DISTINCT impression_id, method FROM candidates WHERE method IS NOT NULL),
        several AS (SELECT impression_id FROM methods GROUP BY 1 HAVING count(*) >= 2),
        items AS (SELECT DISTINCT impression_id, item FROM s JOIN several USING (impression_id)),
        grid AS (SELECT i.impression_id, i.item, m.method, coalesce(s.score, '-infinity'::DOUBLE) AS score
            FROM items i JOIN methods m USING (impression_id)
            LEFT JOIN s ON s.impression_id = i.impression_id AND s.item = i.item AND s.method = m.method),
        duels AS (SELECT x.impression_id, x.item, y.item AS other, sum(sign(
                CASE WHEN x.score > y.score THEN 1 WHEN x.score < y.score THEN -1 ELSE 0 END)) AS votes
            FROM grid x JOIN grid y ON x.impression_id = y.impression_id AND x.method = y.method AND x.item <> y.item GROUP BY ALL),
        lost AS (SELECT DISTINCT impression_id, item FROM duels WHERE votes <= 0)
        SELECT impression_id, item AS article_id FROM items ANTI JOIN lost USING (impression_id, item)""",
}
