"""Splits by time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsweir.operators.asof import micros

_STEPS = (3_600_000_000, 1_000_000, 1)


def positional_cuts(df: DataFrame, group: str, time: str, positions) -> dict[str, list[int]]:
    """For each group the times, in microseconds, at the given places of its sorted times.

    `positions` maps a group's number of rows to places from 0. The places are found exactly without a
    sort: rows are counted by hour, then within the hours hit by second, then by microsecond; each count
    is combined map-side and has at most the range's hours, 3,600 or 10^6 rows per place. Null times and
    null groups are left out; an empty group has no entry.
    """
    t = df.select(F.col(group).alias("g"), micros(time).alias("t")).dropna()
    hours = t.groupBy("g", F.floor(F.col("t") / _STEPS[0]).alias("b")).count().collect()
    wanted: dict[tuple, tuple[int, int]] = {}
    for g in {r["g"] for r in hours}:
        n = sum(r["count"] for r in hours if r["g"] == g)
        for k, place in enumerate(positions(n)):
            wanted[g, k] = (place, 0)

    def narrow(counts, step):
        by: dict[str, list] = {}
        for r in sorted(counts, key=lambda r: r["b"]):
            by.setdefault(r["g"], []).append((r["b"], r["count"]))
        for (g, k), (place, low) in list(wanted.items()):
            for b, n in by[g]:
                if low and not low <= b * step < low + width:
                    continue
                if place < n:
                    wanted[g, k] = (place, b * step)
                    break
                place -= n

    width = 0
    narrow(hours, _STEPS[0])
    for before, step in zip(_STEPS, _STEPS[1:]):
        width = before
        hit = None
        for (g, _), (_, low) in wanted.items():
            one = (F.col("g") == g) & (F.col("t") >= low) & (F.col("t") < low + width)
            hit = one if hit is None else hit | one
        if hit is None:
            return {}
        narrow(t.filter(hit).groupBy("g", F.floor(F.col("t") / step).alias("b")).count().collect(), step)
    out: dict[str, list[int]] = {}
    for (g, _k), (_, at) in sorted(wanted.items()):
        out.setdefault(g, []).append(at)
    return out


def temporal_split(df: DataFrame, time: str, group: str, test_frac: float = 0.15, val_frac: float = 0.15, check: bool = True) -> DataFrame:
    """`df` with `split`: train, val or test by cuts at positions of each group's sorted times.

    The test cut is the time at place int(n * (1 - test_frac)), the validation cut that at int(n * (1 -
    test_frac - val_frac)); times equal to a cut fall into the later part. Rows without time or group are
    left out. Fractions must lie in (0, 1) and add up to less than 1. With `check` the parts are read
    once more, times and groups alone, and a part that reaches into a later one raises.
    """
    if min(test_frac, val_frac) <= 0 or test_frac + val_frac >= 1:
        raise ValueError(f"no room for all parts with test {test_frac} and validation {val_frac} of the rows")
    cuts = positional_cuts(df, group, time, lambda n: [int(n * (1 - test_frac - val_frac)), int(n * (1 - test_frac))])
    t, split = micros(time), None
    for g, (val, test) in cuts.items():
        part = F.when(t < val, "train").when(t < test, "val").otherwise("test")
        case = F.col(group) == g
        split = F.when(case, part) if split is None else split.when(case, part)
    known = df.filter(F.col(time).isNotNull() & F.col(group).isNotNull())
    out = known.withColumn("split", split if split is not None else F.lit(None).cast("string"))
    if check:
        assert_no_leakage(out, time, group)
    return out


def assert_no_leakage(split: DataFrame, time: str, group: str) -> None:
    """Raises if a group's earlier part ends after a later part begins; empty parts are not compared."""
    seen: dict = {}
    for r in split.groupBy(group, "split").agg(F.min(time).alias("low"), F.max(time).alias("high")).collect():
        seen.setdefault(r[group], {})[r["split"]] = (r["low"], r["high"])
    for g, parts in seen.items():
        for a, b in (("train", "val"), ("val", "test")):
            if a in parts and b in parts and parts[a][1] > parts[b][0]:
                raise AssertionError(f"{g}: {a} ends {parts[a][1]}, after {b} begins {parts[b][0]}")
