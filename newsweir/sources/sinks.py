"""Writers: the feature store, retrieved lists, metric reports and submissions."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.durable import file_system


def write_feature_store(tables: dict[str, DataFrame], split: DataFrame, out: str) -> None:
    """articles and user_history, and impressions in a folder per part of the split, so that parts prune."""
    tables["articles"].write.mode("overwrite").parquet(f"{out}/articles.parquet")
    tables["history"].write.mode("overwrite").parquet(f"{out}/user_history.parquet")
    split.write.mode("overwrite").partitionBy("split").parquet(f"{out}/impressions.parquet")


def retrieved_lists(top: DataFrame, key: str) -> DataFrame:
    """(key, retrieved_article_ids, retrieved_scores): a row per key, best first."""
    pairs = F.array_sort(F.collect_list(F.struct("rank", "article_id", "score")))
    one = top.groupBy(key).agg(pairs.alias("_r"))
    return one.select(key, F.col("_r.article_id").alias("retrieved_article_ids"), F.col("_r.score").alias("retrieved_scores"))


def ranks(scored: DataFrame, by: str) -> DataFrame:
    """`scored` with `rank` from 1: the highest score first, equal ones by pos."""
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), "pos")))


def submission(scored: DataFrame, by: str) -> DataFrame:
    """(by, line): 'id [rank,rank,...]', the ranks of an impression's candidates in the order shown."""
    pairs = F.array_sort(F.collect_list(F.struct("pos", "rank")))
    listed = F.array_join(F.transform(pairs, lambda x: x["rank"].cast("string")), ",")
    return ranks(scored, by).groupBy(by).agg(F.concat(F.col(by), F.lit(" ["), listed, F.lit("]")).alias("line"))


def is_permutation(rank_list):
    """True for a list that holds each number from 1 to its length once."""
    return F.array_sort(rank_list) == F.sequence(F.lit(1), F.size(rank_list))


def write_submission(lines: DataFrame, order: str, out: str, inner: str = "predictions.txt") -> str:
    """Lines in the order of a column, as text files in one folder, then as one zip with a fixed inner name.

    The files are sorted by range, so the order holds across them; the zip is filled from them file by file
    by the driver's JVM, through the file system of the folder.
    """
    lines.repartitionByRange(order).sortWithinPartitions(order).select("line").write.mode("overwrite").text(out)
    spark, path = lines.sparkSession, f"{out.rstrip('/')}.zip"
    fs, at = file_system(spark, out)
    parts = sorted((f.getPath().getName(), f.getPath()) for f in fs.listStatus(at))
    jvm, target = spark._jvm, file_system(spark, path)[1]
    z = jvm.java.util.zip.ZipOutputStream(fs.create(target, True))
    z.putNextEntry(jvm.java.util.zip.ZipEntry(inner))
    for name, part in parts:
        if name.startswith("part-"):
            source = fs.open(part)
            jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, z, 1 << 20, False)
            source.close()
    z.closeEntry()
    z.close()
    return path


def write_embeddings(vectors: DataFrame, out: str) -> None:
    """(article_id, embedding) as Parquet, sorted by id within files so that readers can skip row groups."""
    vectors.select("article_id", F.col("embedding").cast("array<float>").alias("embedding")).sortWithinPartitions("article_id").write.mode("overwrite").parquet(out)


def write_report(rows: DataFrame, path: str) -> None:
    """A small table of metrics, a row per dataset, method, slice and metric, as a JSON list of objects."""
    text = json.dumps([r.asDict(recursive=True) for r in rows.collect()], indent=2, default=str)
    fs, at = file_system(rows.sparkSession, path)
    to = fs.create(at, True)
    to.write(bytearray(text.encode()))
    to.close()
