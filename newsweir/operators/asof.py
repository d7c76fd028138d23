"""Attributes as they were known at an event's time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsweir.operators.durable import stored

# Since the epoch, in microseconds: before any time a table holds. The time of what was always known.
ALWAYS = -(2**62)
_FOREVER = 2**62
# An entity's events at one node are salted when there are more of them than this or than this part of all
# events, whichever is more: so many fit a task, and there are fewer than _PART such nodes at any level.
_EVENTS, _PART = 50_000, 2**15


def micros(ts):
    """A timestamp without zone as microseconds since 1970."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def validity(versions: DataFrame, entity: str, time: str, value: str, step: int) -> DataFrame:
    """(entity, value, start, end): half-open intervals of microseconds in which a version is the last known.

    A version of time t is known strictly after t, so start is t + 1 and end the next version's start.
    Of versions of one entity and time the greatest value counts. The next version is looked up in two
    steps, inside ranges of `step` microseconds and then over the ranges, so that a window never spans
    an entity's whole history.
    """
    v = (
        versions.filter(F.col(entity).isNotNull() & F.col(time).isNotNull() & F.col(value).isNotNull())
        .groupBy(entity, time)
        .agg(F.max(value).alias(value))
        .withColumn("_range", F.floor(F.greatest(F.col(time), F.lit(-(2**60))) / step))
    )
    inside = Window.partitionBy(entity, "_range").orderBy(time)
    over = Window.partitionBy(entity).orderBy("_range")
    firsts = v.groupBy(entity, "_range").agg(F.min(time).alias("_first"))
    firsts = firsts.select(entity, "_range", F.lead("_first").over(over).alias("_later"))
    v = v.withColumn("_next", F.lead(time).over(inside)).join(firsts, [entity, "_range"])
    return v.select(
        entity,
        value,
        (F.col(time) + 1).alias("start"),
        (F.coalesce("_next", "_later", F.lit(_FOREVER)) + 1).alias("end"),
    )


def match_spans(
    events: DataFrame, spans: DataFrame, *, entity: str, event_id: str, event_time: str, value: str, spread: int = 16
) -> DataFrame:
    """(event_id, value): for each event the values of its entity whose span holds the event's time.

    `spans` has entity, value and half-open start and end in microseconds. The events' time range is cut
    into 2^bits leaves, each under a dyadic tree of `top` levels. A span is stored at the nodes that make
    it up, none wider than 2^top leaves; an event asks for its leaf and the `top` nodes above it, and nodes
    are matched by an equi-join on (entity, node). A span covers the leaves at its ends only in part, so
    its half-open ends are tested at last.

    `bits` is such that about `spread` of the busiest entity's spans begin in a leaf. `top` is the height
    with the fewest rows to shuffle, counted on the data: high trees ask more of each event, low ones store
    long spans at more nodes. The events of an entity spread over the nodes; a node, a leaf as well, at
    which an entity has over 50,000 events (or 2^-15 of all, if that is more) is salted by their number,
    and its spans are stored once a salt.

    Events without id, entity or time give no row. Copies of an event, equal in the three, count once.
    """
    ev = events.select(
        F.col(entity).alias("_entity"), F.col(event_id).alias("_id"), F.col(event_time).alias("_t")
    ).dropna()
    per = ev.groupBy("_entity").agg(F.min("_t").alias("low"), F.max("_t").alias("high"), F.count(F.lit(1)).alias("n"))
    low, high, total, busiest = per.agg(F.min("low"), F.max("high"), F.sum("n"), F.max("n")).first()
    low, high, total, busiest = (0, 0, 0, 0) if low is None else (low, high, total, busiest)
    most = max(_EVENTS, total // _PART)

    s = spans.select(F.col(entity).alias("_entity"), F.col(value).alias("_v"), "start", "end")
    s = stored(s.filter((F.col("end") > low) & (F.col("start") <= high)))
    longest = s.groupBy("_entity").count().agg(F.max("count")).first()[0] or 1
    bits = min(20, max(4, math.ceil(math.log2(longest / spread + 1))))
    leaf = (high - low) // 2**bits + 1

    def at(t):
        return F.floor((t - low) / leaf).cast("long")

    s = s.withColumn("_a", at(F.greatest(F.col("start"), F.lit(low))))
    s = s.withColumn("_z", at(F.least(F.col("end") - 1, F.lit(high))) + 1)

    def within(level):
        """The first node of a level inside a span and the one after the last."""
        return F.ceil(F.col("_a") / 2**level), F.floor(F.col("_z") / 2**level)

    def ends(level):
        first, last = within(level)
        root = 2 ** (bits - level)
        return F.array(
            F.when((first < last) & (first % 2 == 1), root + first),
            F.when((first < last) & (last % 2 == 1), root + last - 1),
        )

    def rest(level):
        first, last = within(level)
        root = 2 ** (bits - level)
        return F.when(first < last, F.sequence(root + first, root + last - 1)).otherwise(F.array().cast("array<long>"))

    # Rows to shuffle for each height: spans at the odd ends of lower levels and at all nodes of the top one.
    rows = s.select(
        *[F.sum(F.size(F.filter(ends(k), lambda x: x.isNotNull()))).alias(f"e{k}") for k in range(bits)],
        *[F.sum(F.greatest(within(k)[1] - within(k)[0], F.lit(0))).alias(f"r{k}") for k in range(bits + 1)],
    ).first()
    cost = [(k + 1) * total + sum(rows[f"e{j}"] or 0 for j in range(k)) + (rows[f"r{k}"] or 0) for k in range(bits + 1)]
    top = cost.index(min(cost))
    levels = [ends(k) for k in range(top)] + [rest(top)]
    s = s.select("_entity", F.explode(F.filter(F.concat(*levels), lambda x: x.isNotNull())).alias("_node"), "start", "end", "_v")
    # Node numbers as in a heap: the root is 1, the leaves begin at 2^bits, a shift leads to the parent.
    home = F.lit(2**bits) + at(F.col("_t"))

    def above(c):
        return F.explode(F.array(*[F.shiftright(c, k) for k in range(top + 1)]))

    spark, keys, salts = events.sparkSession, ["_entity", "_node", "_salt"], F.coalesce("_salts", F.lit(1))
    hot, shape = [], f"_entity {ev.schema['_entity'].dataType.simpleString()}, _node long, _salts int"
    if busiest > most:
        big = F.broadcast(per.filter(F.col("n") > most).select("_entity"))
        leaves = ev.join(big, "_entity", "left_semi").groupBy("_entity", home.alias("_leaf")).agg(F.count(F.lit(1)).alias("n"))
        nodes = leaves.select("_entity", above(F.col("_leaf")).alias("_node"), "n").groupBy("_entity", "_node").agg(F.sum("n").alias("n"))
        # Under (top + 1) * _PART rows, whatever the data.
        hot = nodes.filter(F.col("n") > most).select("_entity", "_node", F.ceil(F.col("n") / most).cast("int")).collect()
    hot = F.broadcast(spark.createDataFrame(hot, shape))
    # Without copies a result is unique as it is: a span's nodes are disjoint, so an event meets one of them.
    ev = ev.distinct().select("_entity", above(home).alias("_node"), "_id", "_t").join(hot, keys[:2], "left")
    ev = ev.withColumn("_salt", F.pmod(F.hash("_id"), salts)).drop("_salts")
    s = s.join(hot, keys[:2], "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return (
        ev.join(s, keys)
        .filter((F.col("_t") >= F.col("start")) & (F.col("_t") < F.col("end")))
        .select(F.col("_id").alias(event_id), F.col("_v").alias(value))
    )


def last_known(
    events: DataFrame, versions: DataFrame, *, entity: str, event_id: str, event_time: str, version_time: str, value: str
) -> DataFrame:
    """(event_id, value): for each event the entity's value as last known strictly before the event.

    Times are microseconds as longs; a version at ALWAYS was known all along. Each version's validity
    becomes a span of the dyadic tree, see match_spans; spans of an entity are disjoint, so an event has
    at most one row. Events before anything is known have none. Versions lacking entity, time or value
    are ignored; of equal times the greatest value counts. An empty table gives an empty result.
    """
    spans = validity(versions, entity, version_time, value, step=86_400_000_000)
    return match_spans(events, spans, entity=entity, event_id=event_id, event_time=event_time, value=value)


def all_known(
    events: DataFrame, versions: DataFrame, *, entity: str, event_id: str, event_time: str, version_time: str, value: str
) -> DataFrame:
    """(event_id, value): for each event every value of the entity known strictly before the event, once.

    As last_known, but a version stays known for good. Values are not ordered here; versions lacking
    entity, time or value are ignored.
    """
    v = versions.dropna(subset=[entity, version_time, value]).groupBy(entity, value).agg(F.min(version_time).alias("_t"))
    spans = v.select(entity, value, (F.col("_t") + 1).alias("start"), F.lit(_FOREVER).alias("end"))
    return match_spans(events, spans, entity=entity, event_id=event_id, event_time=event_time, value=value)
