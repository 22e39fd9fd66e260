"""Compositing of packed pixels; channels are fractions of 255 while they are combined, and truncated back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.colors import channel, pack

IMAGE = ("over", "add", "saturate", "source")
ARRAY = ("add", "max", "min", "source")


def combine(src: Column, dst: Column, how: str = "over") -> Column:
    """src composited onto dst."""
    if how not in IMAGE:
        raise ValueError(f"unknown compositing operator {how!r}")
    if how == "source":
        return F.when(channel(src, 3) > 0, src).otherwise(dst)
    s, d = ([channel(c, n) / F.lit(255.0) for n in range(4)] for c in (src, dst))
    sa, da = s[3], d[3]
    if how == "over":
        factor, alpha = 1 - sa, sa + da * (1 - sa)
        mix = [x * sa + y * da * factor for x, y in zip(s[:3], d[:3])]
        mix = [m / F.nullif(alpha, F.lit(0.0)) for m in mix]
    elif how == "add":
        alpha = F.least(F.lit(1.0), sa + da)
        mix = [(x * sa + y * da) / F.nullif(alpha, F.lit(0.0)) for x, y in zip(s[:3], d[:3])]
    else:
        alpha = F.least(F.lit(1.0), sa + da)
        factor = F.least(sa, 1 - da)
        mix = [(factor * x + y * da) / F.nullif(alpha, F.lit(0.0)) for x, y in zip(s[:3], d[:3])]
    out = [F.least(F.lit(1.0), F.coalesce(m, F.lit(0.0))) * 255 for m in mix]
    return pack(*out, F.least(F.lit(1.0), alpha) * 255)


def combine_values(src: Column, dst: Column, how: str = "add") -> Column:
    """src onto dst for plain values, of which null is none."""
    if how not in ARRAY:
        raise ValueError(f"unknown array operator {how!r}")
    if how == "source":
        return F.coalesce(src, dst)
    if how == "add":
        return F.coalesce(src + dst, src, dst)
    return (F.greatest if how == "max" else F.least)(src, dst)


def stack(images: list[DataFrame], how: str = "over") -> DataFrame:
    """Images (py, px, rgba) one over the other, the first at the bottom; pixels that only some have are kept."""
    if not images:
        raise ValueError("nothing to stack")
    out = images[0]
    for top in images[1:]:
        both = out.withColumnRenamed("rgba", "_d").join(top.withColumnRenamed("rgba", "_s"), ["py", "px"], "full")
        zero = F.lit(0).cast("long")
        out = both.select("py", "px", combine(F.coalesce("_s", zero), F.coalesce("_d", zero), how).alias("rgba"))
    return out
