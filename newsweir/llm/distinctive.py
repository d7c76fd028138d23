"""How distinctive a term is per record, by a two-Poisson mixture."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweir.functions.text import terms
from newsweir.operators.durable import stored
from newsweir.operators.skew import hot_keys, skew_join

_STEPS = 60


def fit_two_poisson(held: np.ndarray, owner: np.ndarray, tf: np.ndarray, n: np.ndarray, records: int):
    """(weight of the elite component, its mean, the other's mean) of each term, by expectation-maximisation.

    The histograms of all terms lie one after another: `n` records hold term `owner` exactly `tf` times,
    `held` records hold it at all, the rest of `records` never. All terms are fitted at once.
    """
    size = len(held)
    none = np.maximum(records - held, 0).astype(float)
    add = lambda x: np.bincount(owner, x, size)
    most = np.zeros(size)
    np.maximum.at(most, owner, tf)
    total = add(n * tf)
    elite, base = most.astype(float), np.maximum(0.5 * total / records, 1e-9)
    weight = np.clip(0.5 * held / records, 1e-12, 0.5)
    for _ in range(_STEPS):
        lift = np.log(weight) - np.log1p(-weight) - elite + base
        slope = np.log(elite) - np.log(base)
        of = 1 / (1 + np.exp(-np.clip(lift[owner] + tf * slope[owner], -700, 700)))
        of_none = 1 / (1 + np.exp(-np.clip(lift, -700, 700)))
        mass = add(n * of) + none * of_none
        mean = add(n * of * tf)
        weight = np.clip(mass / records, 1e-12, 1 - 1e-12)
        elite = np.maximum(mean / np.maximum(mass, 1e-12), 1e-9)
        base = np.maximum((total - mean) / np.maximum(records - mass, 1e-12), 1e-9)
        # The elite component is the one with the greater mean.
        swap = base > elite
        elite, base = np.where(swap, base, elite), np.where(swap, elite, base)
        weight = np.where(swap, 1 - weight, weight)
    return np.clip(weight, 1e-12, 1 - 1e-12), elite, base


def term_counts(records: DataFrame, record_id: str, text: Column) -> DataFrame:
    """(record_id, term, tf) of all records. A record's copies, with the same id and text, count once."""
    one = records.select(record_id, text.alias("_text")).filter(F.col(record_id).isNotNull()).distinct()
    long = one.select(record_id, F.explode(terms(F.col("_text"))).alias("term"))
    return long.groupBy(record_id, "term").agg(F.count(F.lit(1)).alias("tf"))


def distinctive_terms(records: DataFrame, record_id: str, text: Column) -> DataFrame:
    """(record_id, term, tf, df, p_elite, score) of every term of every record.

    Over the whole collection each term has a histogram: how many records hold it once, twice and so on,
    or never. A mixture of two Poisson distributions, of the records the term is about (elite) and of the
    others, is fitted to it; p_elite is the posterior probability of the elite component at the record's
    count, and score weighs it by how rare elite records are, -ln of the component's weight. A term spread
    evenly over the records fits one Poisson distribution: its score is near 0.

    Records without id are left out, null texts are empty, records without terms give no rows. Only the
    histograms are shuffled to the fit. Terms held by so many records that they make up over 1/512 of all
    (record, term) rows, of which there are under 512, get their parameters by broadcast.
    """
    # Read by the fit, for the hot terms and for the result: made and shuffled once.
    tf = stored(term_counts(records, record_id, text))
    n_records = records.select(record_id).filter(F.col(record_id).isNotNull()).distinct().count()
    histogram = tf.groupBy("term", "tf").agg(F.count(F.lit(1)).alias("n"))
    per_term = histogram.groupBy("term").agg(
        F.sum("n").alias("df"), F.collect_list("tf").alias("tfs"), F.collect_list("n").alias("ns")
    )

    def fit(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            owner = np.repeat(np.arange(len(f)), f["tfs"].map(len))
            values = [np.concatenate(f[c].to_numpy()).astype(float) if len(f) else np.zeros(0) for c in ("tfs", "ns")]
            weight, elite, base = fit_two_poisson(f["df"].to_numpy(float), owner, *values, n_records)
            yield pd.DataFrame({"term": f["term"], "df": f["df"], "weight": weight, "elite": elite, "base": base})

    fitted = per_term.mapInPandas(fit, "term string, df long, weight double, elite double, base double")
    fitted = stored(fitted)
    total = tf.count()
    # As many terms as hold over 1/512 of the rows: fewer than 512, each with its number of rows among the fitted.
    hot = hot_keys(fitted, ["term"], total, weight=F.col("df"))
    joined = skew_join(tf, fitted, ["term"], hot)
    odds = F.ln("weight") - F.ln(1 - F.col("weight")) - F.col("elite") + F.col("base")
    logit = odds + F.col("tf") * (F.ln("elite") - F.ln("base"))
    return (
        joined.withColumn("p_elite", 1 / (1 + F.exp(-F.least(F.greatest(logit, F.lit(-700.0)), F.lit(700.0)))))
        .withColumn("score", F.col("p_elite") * -F.ln("weight"))
        .select(record_id, "term", "tf", "df", "p_elite", "score")
    )
