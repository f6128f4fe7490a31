"""Null tests: a small grammar of splits by statistics, and summaries of simulations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import balanced_groups


@dataclass(frozen=True)
class Knife:
    """A parsed split: kind is equal (n groups of about equal weight), ranges, modular or edges."""

    stat: str
    kind: str
    parts: tuple


def parse(spec: str) -> Knife:
    """name(n) | name[a:b+c:d,...] | name{zero:step:n} | name<e1,e2,...>"""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((\d+)\)|\[([^\]]+)\]|\{([^}]+)\}|<([^>]+)>)\s*", spec)
    if not m:
        raise ValueError(f"not a split: {spec}")
    name, n, ranges, modular, edges = m.groups()
    if n:
        return Knife(name, "equal", (int(n),))
    if ranges:
        return Knife(name, "ranges", tuple(tuple(tuple(map(float, r.split(":"))) for r in group.split("+")) for group in ranges.split(",")))
    if modular:
        zero, step, count = modular.split(":")
        return Knife(name, "modular", (float(zero), float(step), int(count)))
    return Knife(name, "edges", tuple(map(float, edges.split(","))))


def group_of(k: Knife) -> Column:
    """Group from 1 by the statistic's value, 0 for none. Equal-weight splits need assign()."""
    x = F.col(k.stat)
    if k.kind == "ranges":
        out = F.lit(0)
        for i, group in reversed(list(enumerate(k.parts, 1))):
            hit = F.lit(False)
            for a, b in group:
                hit = hit | ((x >= a) & (x < b))
            out = F.when(hit, i).otherwise(out)
        return out
    if k.kind == "modular":
        zero, step, n = k.parts
        return (F.pmod(F.floor((x - zero) / step), F.lit(n)) + 1).cast("int")
    out = F.lit(len(k.parts) + 1)
    for i, e in reversed(list(enumerate(k.parts, 1))):
        out = F.when(x < e, i).otherwise(out)
    return out


def assign(df: DataFrame, knife: Knife, keys: list[str], weight: str | None, out: str) -> DataFrame:
    """Adds the group of a split; equal-weight splits balance ``weight`` (1 if None) within ``keys``."""
    if knife.kind != "equal":
        return df.withColumn(out, group_of(knife))
    w = weight or "_w"
    got = balanced_groups(df if weight else df.withColumn("_w", F.lit(1.0)), keys, knife.stat, w, knife.parts[0], out)
    return got if weight else got.drop("_w")


def product(groups: list[tuple[Column, int]]) -> Column:
    """Index from 1 of a combination of groups (column, number of groups); 0 where any is 0."""
    out, none = F.lit(0), F.lit(False)
    for c, n in groups:
        out, none = out * n + (c - 1), none | (c == 0)
    return F.when(none, 0).otherwise(out + 1)


def pte(sims: DataFrame, keys: list[str], stat: str, data: str) -> DataFrame:
    """Share of simulations above the data, and the data's distance from their mean in deviations."""
    s = F.col(stat)
    return sims.groupBy(*keys, data).agg(F.avg((s > F.col(data)).cast("double")).alias("pte"), ((F.first(data) - F.avg(s)) / F.stddev_samp(s)).alias("sigma"))
