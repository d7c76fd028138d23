"""Mixing sources to target weights."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsweir.operators.durable import stored
from newsweir.operators.skew import salted_prefix


def source_name(c: Column) -> Column:
    """A source's name however it is spelled: trimmed, in lower case, with hyphens."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[_\s]+", "-")


def share_out(amount: float, weights: dict, limits: dict) -> dict:
    """`amount` by weight, no one above their limit; what some can't take goes to the others by weight."""
    given = dict.fromkeys(weights, 0.0)
    open_ = {k for k, w in weights.items() if w > 0 and limits[k] > 0}
    left = amount
    while open_ and left > 1e-9:
        whole = sum(weights[k] for k in open_)
        full = {k for k in open_ if given[k] + left * weights[k] / whole >= limits[k]}
        if not full:
            for k in open_:
                given[k] += left * weights[k] / whole
            break
        for k in full:
            left -= limits[k] - given[k]
            given[k] = limits[k]
        open_ -= full
        # What is given to the others is worked out afresh from what the full ones left.
    return given


_LEVELS = ("domain", "language", "source")


def leaf_key(leaf: dict) -> tuple:
    return tuple(leaf[x] for x in _LEVELS)


def tree_budgets(total: float, leaves: list[dict]) -> dict[tuple, float]:
    """Tokens of each leaf, by (domain, language, source): `total` down a tree of domains, languages and sources.

    A leaf is what a source has of one domain and language, with share and limit (its tokens times the
    repeats allowed). At each node the amount is shared out among the children by the sum of their leaves' shares, none above what
    its leaves can give. So what a leaf lacks goes to sources of its domain and language first, then
    to the domain's other languages, then to other domains.
    """

    def down(amount: float, some: list[dict], levels: tuple[str, ...], above: tuple) -> dict[tuple, float]:
        groups: dict[str, list[dict]] = defaultdict(list)
        for x in some:
            groups[x[levels[0]]].append(x)
        given = share_out(
            amount, {k: sum(x["share"] for x in g) for k, g in groups.items()}, {k: sum(x["limit"] for x in g) for k, g in groups.items()}
        )
        if len(levels) == 1:
            return {(*above, k): n for k, n in given.items()}
        return {s: n for k, g in groups.items() for s, n in down(given[k], g, levels[1:], (*above, k)).items()}

    return down(total, leaves, _LEVELS, ())


def largest_exact_total(leaves: list[dict]) -> float:
    """The largest total at which each leaf that has tokens gets what its share says.

    Shares of leaves without tokens are handed on by the tree first, whatever the total.
    """
    open_ = [{**x, "limit": 1e18 if x["limit"] > 0 else 0.0} for x in leaves]
    shares = tree_budgets(1e6, open_)
    return min((x["limit"] / (shares[leaf_key(x)] / 1e6) for x in leaves if shares[leaf_key(x)] > 0), default=0.0)


def mix(
    documents: DataFrame,
    targets: DataFrame,
    *,
    doc: str,
    source: str,
    domain: Column,
    language: str,
    size: str,
    total: str = "exact",
    seed: int = 9,
) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares): documents of each mix with their copies, and the shares planned and reached.

    `targets` has mix_name, source, target_share and max_repeats, a row per source of a mix: a table of
    settings, read by the driver. chosen is (mix_name, source, doc, size, copies); shares is (mix_name,
    source, target_share, planned_share, reached_share, tokens, documents, most_copies).

    The size of a mix, `total`, is "exact": the largest at which each source present can have its share
    without more than max_repeats copies of a document; or "all": as much as the mix's sources hold once,
    where a source too small gives what it can and the tree redistributes its shortage, see tree_budgets.
    `domain` is any column; a leaf of the tree is a source's documents of one domain and language, and has
    the part of the source's share that it has of the source's tokens. A source that is absent has a leaf of
    no domain, so its share is handed on from the root.

    A leaf's budget is met by whole epochs and a prefix of a last one; each epoch orders the leaf's
    documents by a seeded hash, and the prefix ends at the document nearest to the budget; what the prefixes of
    a source's leaves are off by is made up in its largest leaf. Running sums
    never gather a leaf in a task. Leaves are counted on the driver: domains, languages and the sources of
    `targets` are labels with few values. Sources are matched however they are spelled. Documents without id
    or source are in no mix; those of size 0 or null are in the epochs but change no share. A mix whose sources are all empty has
    no documents and a reached_share of 0. Shares are of the mix's sum.
    """
    spark = documents.sparkSession
    docs = documents.select(
        F.col(doc),
        source_name(F.col(source)).alias("source"),
        F.coalesce(domain, F.lit("")).alias("_domain"),
        F.coalesce(F.col(language), F.lit("")).alias("_language"),
        F.coalesce(F.col(size), F.lit(0)).cast("long").alias(size),
    ).filter(F.col(doc).isNotNull() & F.col("source").isNotNull())
    wanted = targets.select("mix_name", source_name(F.col("source")).alias("source"), "target_share", "max_repeats").collect()
    names = spark.createDataFrame([(s,) for s in sorted({w["source"] for w in wanted})], "source string")
    docs = docs.join(F.broadcast(names), "source", "left_semi")

    cells: dict[str, list] = defaultdict(list)
    tokens: dict[str, int] = defaultdict(int)
    for r in docs.groupBy("source", "_domain", "_language").agg(F.sum(size).alias("n")).collect():
        tokens[r["source"]] += r["n"]
        cells[r["source"]].append((r["_domain"], r["_language"], r["n"]))

    plan, sources = [], []
    for m in sorted({w["mix_name"] for w in wanted}):
        leaves = [
            {
                "source": w["source"],
                "domain": domain_,
                "language": language_,
                "share": w["target_share"] * (n / tokens[w["source"]] if tokens[w["source"]] else 1.0),
                "repeats": w["max_repeats"],
                "n": n,
                "limit": float(n * w["max_repeats"]),
            }
            for w in wanted
            if w["mix_name"] == m
            for domain_, language_, n in sorted(cells[w["source"]]) or [("", "", 0)]
        ]
        whole = largest_exact_total(leaves) if total == "exact" else float(sum(x["n"] for x in leaves))
        budgets = tree_budgets(whole, leaves)
        got = sum(budgets.values()) or 1.0
        planned: dict[str, float] = defaultdict(float)
        for x in leaves:
            n, budget = x["n"], budgets[leaf_key(x)]
            planned[x["source"]] += budget / got
            epochs = min(x["repeats"], int((budget + 0.5) // n)) if n else 0
            rest = budget - epochs * n if epochs < x["repeats"] else 0.0
            plan.append((m, x, epochs, max(rest, 0.0)))
        sources += [(m, w["source"], float(w["target_share"]), planned[w["source"]]) for w in wanted if w["mix_name"] == m]

    leaf = ["source", "_domain", "_language"]
    budgeted = [(m, *(x[c] for c in ("source", "domain", "language")), epochs, rest) for m, x, epochs, rest in plan]
    budgeted = spark.createDataFrame(budgeted, "mix_name string, source string, _domain string, _language string, _epochs int, _rest double")
    settings = spark.createDataFrame(sources, "mix_name string, source string, target_share double, planned_share double")
    # As many rows as there are leaves in all mixes.
    rows = docs.join(F.broadcast(budgeted), leaf).select(
        "mix_name",
        *leaf,
        doc,
        size,
        "_epochs",
        "_rest",
        F.pmod(F.xxhash64(doc, F.lit(seed), "mix_name", "_epochs"), F.lit(2**32)).alias("_order"),
    )
    ordered = stored(salted_prefix(rows, ["mix_name", *leaf], "_order", doc, F.col(size), "_before").drop("_order"))

    def last(rest):
        return (F.col("_before") + F.col(size) / 2 <= rest) & (rest > 0)

    # What the leaves' prefixes miss or exceed for want of a fitting document is made up in their source's
    # largest leaf, so that a source is off by part of one document and not of one a leaf.
    by = ["mix_name", *leaf]
    took = {tuple(r[c] for c in by): r["n"] for r in ordered.filter(last(F.col("_rest"))).groupBy(*by).agg(F.sum(size).alias("n")).collect()}
    whole_source: dict[tuple, list] = defaultdict(list)
    for m, x, epochs, rest in plan:
        whole_source[m, x["source"]].append((x, epochs, rest, took.get((m, x["source"], x["domain"], x["language"]), 0)))
    rests = []
    for (m, s), some in whole_source.items():
        open_ = [x["n"] for x, epochs, _, _ in some if epochs < x["repeats"]]
        anchor = max(open_, default=None)
        off = sum(rest - n for _, _, rest, n in some)
        for x, epochs, rest, n in some:
            if anchor is not None and epochs < x["repeats"] and x["n"] == anchor:
                rest, anchor = min(max(rest + off - (rest - n), 0.0), float(x["n"])), None
            rests.append((m, s, x["domain"], x["language"], rest))
    exact = spark.createDataFrame(rests, "mix_name string, source string, _domain string, _language string, _exact double")
    ordered = ordered.join(F.broadcast(exact), by)
    last = last(F.col("_exact"))
    chosen = ordered.withColumn("copies", F.col("_epochs") + last.cast("int")).filter(F.col("copies") > 0)
    chosen = chosen.select("mix_name", "source", doc, size, "copies")
    per = chosen.groupBy("mix_name", "source").agg(
        F.sum(F.col(size) * F.col("copies")).alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies")
    )
    shares = settings.join(per, ["mix_name", "source"], "left").fillna(0, ["tokens", "documents", "most_copies"])
    sums = shares.groupBy("mix_name").agg(F.sum("tokens").alias("_all"))
    shares = shares.join(F.broadcast(sums), "mix_name").select(
        "mix_name",
        "source",
        "target_share",
        "planned_share",
        F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0).alias("reached_share"),
        "tokens",
        "documents",
        "most_copies",
    )
    return chosen, shares
