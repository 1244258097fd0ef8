"""Scores, decays and other scalar formulas."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR, DAY = 3600, 86400


def hours_since(t: Column, pub_s: Column) -> Column:
    """Age in hours, not below 0."""
    return F.greatest(F.lit(0.0), (t - pub_s) / F.lit(3600.0))


def half_life(age_s: Column, half_life_s: float) -> Column:
    return F.pow(F.lit(0.5), age_s / F.lit(float(half_life_s)))


def floored_decay(age_s: Column, half_life_days: float, least: float) -> Column:
    """Decay by whole days with a least weight."""
    return F.greatest(F.lit(least), F.pow(F.lit(0.5), F.floor(age_s / DAY) / F.lit(float(half_life_days))))


def recency_popularity(age_h: Column, clicks: Column) -> Column:
    return F.exp(-F.greatest(age_h, F.lit(0.0)) / 48) + F.log1p(clicks.cast("double")) / 5


def heuristic_v2(weights: tuple[float, float, float, float], long: Column, short: Column, age_h: Column, clicks: Column) -> Column:
    """Two cosines, freshness and log popularity; a missing term counts 0."""
    terms = (long, short, F.exp(-age_h / 48), F.log1p(clicks.cast("double")))
    parts = [F.lit(w) * F.coalesce(x, F.lit(0.0)) for w, x in zip(weights, terms, strict=True)]
    return parts[0] + parts[1] + parts[2] + parts[3]


def heuristic_v1(
    weights: tuple[float, float, float, float], long: Column, short: Column, age_h: Column, count: Column
) -> Column:
    """The same kinds of terms with capped popularity; a missing cosine hands its weight to the other one."""
    a, b, c, d = map(F.lit, weights)
    of_long = F.when(short.isNull(), a + b).otherwise(a)
    of_short = F.when(short.isNull(), F.lit(0.0)).when(long.isNull(), a + b).otherwise(b)
    popular = F.least(F.lit(1.0), F.log1p(count.cast("double")) / 5)
    personal = of_long * F.coalesce(long, F.lit(0.0)) + of_short * F.coalesce(short, F.lit(0.0))
    return personal + c * F.exp(-age_h / 48) + d * popular


def ctr(clicks: Column, views: Column) -> Column:
    return clicks / F.greatest(views, F.lit(1)).cast("double")


def shrunk_ctr(clicks: Column, views: Column, prior: Column, strength: float) -> Column:
    return (clicks + F.lit(float(strength)) * prior) / (views + F.lit(float(strength)))


def examination(position: Column, eta: Column) -> Column:
    """The chance that a place of a list, counted from 0, is looked at."""
    return F.pow(position + F.lit(1.0), -eta)


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The Wilson interval of k of n; null without trials."""
    k, n = k.cast("double"), F.when(n > 0, n.cast("double"))
    p, square = k / n, z * z
    centre = (p + square / (2 * n)) / (1 + square / n)
    half = z * F.sqrt(p * (1 - p) / n + square / (4 * n * n)) / (1 + square / n)
    return F.greatest(F.lit(0.0), centre - half), F.least(F.lit(1.0), centre + half)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sample_size(p: float, lift: float, alpha_z: float = 1.959963984540054, power_z: float = 0.8416212335729143) -> int:
    """Trials for each of two arms to find a relative change of a rate."""
    q = p * (1 + lift)
    mean = (p + q) / 2
    root = alpha_z * math.sqrt(2 * mean * (1 - mean)) + power_z * math.sqrt(p * (1 - p) + q * (1 - q))
    return math.ceil(root**2 / (p - q) ** 2)


def age_band(year: Column, now: int) -> Column:
    age = F.lit(now) - year
    return (
        F.when(year.isNull(), "unknown").when(age < 20, "10s").when(age < 30, "20s").when(age < 40, "30s")
        .when(age < 50, "40s").when(age < 60, "50s").otherwise("60+")
    )


def bucket(value: Column, edges: list[float], names: list[str]) -> Column:
    """The name of the first edge that a value is below; the last name from the last edge on."""
    out = F.when(value < edges[0], names[0])
    for edge, name in zip(edges[1:], names[1:], strict=False):
        out = out.when(value < edge, name)
    return out.otherwise(names[-1])


def release(t: Column, hour: int, ceil: bool = True) -> Column:
    """The next (or previous) daily release at this hour, in seconds."""
    shifted = t - hour * HOUR
    days = F.ceil(shifted / DAY) if ceil else F.floor(shifted / DAY)
    return days * DAY + hour * HOUR


def explore_propensity(explore: int, slate: int, pool: Column) -> Column:
    """The chance that an item of the pool is the one explored at a place: (explore / slate) / size of the pool."""
    return F.when(pool > 0, F.lit(explore / slate) / pool)


def md5_number(*parts: Column) -> Column:
    """A repeatable number from 0 to 2**32 - 1, the same in any engine that has MD5."""
    text = F.concat_ws(":", *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
