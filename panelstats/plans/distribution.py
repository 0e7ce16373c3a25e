"""How the returns of a series are distributed, and how they move with another series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..shared import stored
from ..spec import PanelSpec


#: Parts of a series' days that are joined apart.
SLICES = 32
#: Series of a band that are compared in a task; series of a block, and pairs of a task, that are checked together.
MET, BLOCK, GROUP = 1024, 256, 2048


def normality(returns: DataFrame, spec: PanelSpec = PanelSpec(), ret: str = "daily_return") -> DataFrame:
    """Population skewness, excess kurtosis and the Jarque-Bera statistic of every series."""
    moments = returns.groupBy(spec.key).agg(
        F.count(ret).alias("n"), F.skewness(ret).alias("skewness"), F.kurtosis(ret).alias("kurtosis")
    )
    statistic = F.col("n") / 6 * (F.pow("skewness", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4)
    return moments.withColumn("jarque_bera", statistic)


def return_correlation(
    returns: DataFrame, pairs: DataFrame, spec: PanelSpec = PanelSpec(), ret: str = "daily_return", slices: int = SLICES
) -> DataFrame:
    """Correlation of the returns of each given pair (``key_a``, ``key_b``) over their common days.

    The pairs are the caller's: all pairs of a panel grow with the square of its series, chosen ones
    cost their number times the length of a series.  A series that is in very many pairs is dealt by
    day, on either side: by ``slices`` of its days on the left, by the days themselves on the right.  Series on the
    right are stored first, so that a few of them, in pairs with very many, are sent to the rows of the others.
    """
    series = returns.select(*spec.grid, ret).filter(F.col(ret).isNotNull())
    first = series.select(F.col(spec.key).alias("key_a"), spec.ts, F.col(ret).alias("_a"))
    second = series.select(F.col(spec.key).alias("key_b"), spec.ts, F.col(ret).alias("_b"))
    second = stored(second.join(pairs.select("key_b").distinct(), "key_b", "left_semi"), "right-returns")
    slice_of = F.pmod(F.hash(spec.ts), F.lit(slices))
    sliced = pairs.select("key_a", "key_b", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"))
    first = first.withColumn("_slice", slice_of).repartition("key_a", "_slice")
    left = sliced.repartition("key_a", "_slice").join(first, ["key_a", "_slice"]).drop("_slice")
    common = left.join(second, ["key_b", spec.ts])
    per_pair = common.groupBy("key_a", "key_b").agg(
        F.count("*").alias("days"),
        F.covar_samp("_a", "_b").alias("_cov"),
        F.stddev_samp("_a").alias("_da"),
        F.stddev_samp("_b").alias("_db"),
    )
    return per_pair.select(
        "key_a", "key_b", "days", ratio("_cov", F.col("_da") * F.col("_db")).alias("correlation")
    )


# All strongly correlated pairs


def bands_needed(threshold: float, overlap: float, bits: int, recall: float) -> int:
    """Bands of ``bits`` signs so that a pair at the threshold shares one with a probability of ``recall``.

    Of two series whose values on their common days correlate by ``threshold``, and that have at least ``overlap`` of
    their days in common, the vectors over all days correlate by about ``threshold * overlap``; the signs of a
    random projection agree with the probability ``1 - angle / pi``.
    """
    agree = 1 - math.acos(threshold * overlap) / math.pi
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree**bits)))


def _signs(days: np.ndarray, n: int) -> np.ndarray:
    """A row of ``n`` signs for each day, the same wherever the day occurs."""
    words = np.arange(1, n // 64 + 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = days.astype(np.int64).view(np.uint64)[:, None] * np.uint64(0xD1342543DE82EF95) + words
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(31)
    bits = np.unpackbits(x.view(np.uint8).reshape(len(days), -1), axis=1)[:, :n]
    return bits.astype(np.float32) * 2 - 1


def return_sketches(returns: DataFrame, bands: int, bits: int, spec: PanelSpec = PanelSpec(), ret: str = "daily_return") -> DataFrame:
    """Per series with returns that vary: its number of days, ``bits`` signs for each band, its days and returns.

    A group is one series, which the calendar bounds.
    """
    day = F.datediff(spec.ts, F.lit("1970-01-01").cast("date"))
    rows = returns.filter(F.col(ret).isNotNull() & F.col(spec.key).isNotNull())
    rows = rows.select(F.col(spec.key).alias("key"), day.alias("day"), F.col(ret).cast("double").alias("value"))
    names = ["key", "days", "bands", "bits", "signs", "at", "value"]

    def sketch(key: tuple, series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("day")
        at, own = series["day"].to_numpy(), series["value"].to_numpy()
        value = own - own.mean()
        if not np.isfinite(value).all() or not (value * value).sum() > 0:
            return pd.DataFrame([], columns=names)
        sums = (value / np.abs(value).max()) @ _signs(at, bands * bits)
        signs = np.packbits(sums > 0).tobytes()
        return pd.DataFrame([(key[0], len(at), bands, bits, signs, at.astype("<i4").tobytes(), own.astype("<f8").tobytes())], columns=names)

    kinds = f"key {rows.schema['key'].dataType.simpleString()}, days long, bands int, bits int, signs binary, at binary, value binary"
    return rows.groupBy("key").applyInPandas(sketch, kinds)


def _unpacked(signs: list[bytes], bands: int, bits: int) -> np.ndarray:
    """Signs of all bands as 0 and 1, a row for each sketch."""
    rows = np.frombuffer(b"".join(signs), np.uint8).reshape(len(signs), -1)
    return np.unpackbits(rows, axis=1)[:, : bands * bits]


def most_signs_apart(threshold: float, overlap: float, signs: int) -> int:
    """Signs of all bands that a pair at the threshold differs in at most, up to five deviations of chance."""
    differ = math.acos(threshold * overlap) / math.pi
    return math.ceil(signs * differ + 5 * math.sqrt(signs * differ * (1 - differ)))


def candidate_pairs(sketches: DataFrame, overlap: float = 0.9, apart: int | None = None) -> DataFrame:
    """key_a, key_b and the days of the longer one, of series that share a band; every pair once.

    A pair is taken in the first band it shares, so it needs no further exchange, and only if at most ``apart`` signs
    of all bands differ.  Buckets of a band are put together to groups of about ``MET`` series, and a larger bucket
    is cut into blocks of that many, so that a task compares two blocks at most.
    """
    parts = max(1, -(-sketches.count() // MET))
    kind = sketches.schema["key"].dataType.simpleString()

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for given in batches:
            for (bands, bits), some in given.groupby(["bands", "bits"]):
                codes = _unpacked(list(some["signs"]), bands, bits).reshape(len(some), bands, bits) @ (1 << np.arange(bits))
                out = some.loc[some.index.repeat(bands)]
                yield out.assign(band=np.tile(np.arange(bands, dtype=np.int32), len(some)), part=(codes.ravel() % parts).astype(np.int32))

    plain = sketches.select("key", "days", "bands", "bits", "signs")
    each = plain.mapInPandas(dealt, f"key {kind}, days long, bands int, bits int, signs binary, band int, part int")
    sizes = each.groupBy("band", "part").agg(F.ceil(F.count("*") / (2 * MET)).cast("int").alias("blocks"))
    large = stored(sizes.filter(F.col("blocks") > 1), "large-buckets")
    cut = each.join(large, ["band", "part"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})

    def meet(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key", ignore_index=True)
        band, _, low, high = key
        bands, bits = int(rows["bands"][0]), int(rows["bits"][0])
        signs = _unpacked(list(rows["signs"]), bands, bits)
        codes = (signs.reshape(len(rows), bands, bits) @ (1 << np.arange(bits))).astype(np.int32)
        ones, days, block, own = signs.astype(np.float32) * 2 - 1, rows["days"].to_numpy(), rows["block"].to_numpy(), codes[:, band]
        found = []
        for i in range(0, len(rows), 256):
            some = slice(i, i + 256)
            near = own[some, None] == own[None, i:]
            if apart is not None:
                near &= ones[some] @ ones[i:].T >= bands * bits - 2 * apart
            near &= np.minimum(days[some, None], days[None, i:]) >= np.maximum(days[some, None], days[None, i:]) * overlap
            if low != high:
                near &= block[some, None] != block[None, i:]
            a, b = np.nonzero(np.triu(near, 1))
            for j in range(0, len(a), 1 << 16):
                x, y = a[j : j + (1 << 16)] + i, b[j : j + (1 << 16)] + i
                first = (codes[x] == codes[y]).argmax(axis=1) == band
                found.append((x[first], y[first]))
        a, b = (np.concatenate([f[side] for f in found]) if found else np.empty(0, np.int64) for side in (0, 1))
        keys = rows["key"].to_numpy()
        return pd.DataFrame({"key_a": keys[a], "key_b": keys[b], "most_days": np.maximum(days[a], days[b])})

    return cut.groupBy("band", "part", "low", "high").applyInPandas(meet, f"key_a {kind}, key_b {kind}, most_days long")


def checked_pairs(sketches: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (stored, like the sketches) with their common days and their correlation over these.

    Series that are in pairs with the same least series form blocks of ``BLOCK`` at most, and the pairs between two
    blocks are computed together, so a series travels once for the blocks it meets, not once a pair.
    """
    kind = sketches.schema["key"].dataType.simpleString()
    ends = [pairs.select(F.col(f"key_{x}").alias("key"), F.col(f"key_{y}").alias("other")) for x, y in ("ab", "ba")]
    leads = ends[0].union(ends[1]).groupBy("key").agg(F.min("other").alias("other")).select("key", F.least("key", "other").alias("lead"))
    leads = stored(leads, "leads")
    blocks = leads.groupBy("lead").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = F.xxhash64("lead", F.pmod(F.xxhash64("key"), "blocks"))
    blocks = stored(leads.join(blocks, "lead").select("key", block.alias("block")), "blocks")
    placed = pairs
    for x in "ab":
        placed = placed.join(blocks.select(F.col("key").alias(f"key_{x}"), F.col("block").alias(f"block_{x}")), f"key_{x}")
    groups = max(1, -(-pairs.count() // GROUP))
    placed = stored(placed.withColumn("part", F.pmod(F.xxhash64("block_a", "block_b"), F.lit(groups))), "placed-pairs")
    sides = [placed.select(F.col("part").alias("of"), F.col(c).alias("key")) for c in ("key_a", "key_b")]
    members = sides[0].union(sides[1]).distinct().join(sketches.select("key", "at", "value"), "key")

    def check(rows: pd.DataFrame, series: pd.DataFrame) -> pd.DataFrame:
        known = {k: (np.frombuffer(at, "<i4"), np.frombuffer(v, "<f8")) for k, at, v in zip(series["key"], series["at"], series["value"], strict=True)}
        out = []
        for _, some in rows.groupby(["block_a", "block_b"]):
            (a, keys_a), (b, keys_b) = pd.factorize(some["key_a"]), pd.factorize(some["key_b"])
            days, correlation = _correlations([known[k] for k in keys_a], [known[k] for k in keys_b], a, b)
            out.append(some[["key_a", "key_b", "most_days"]].assign(days=days, correlation=correlation))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("key_a", "key_b", "most_days", "days", "correlation")})

    kinds = f"key_a {kind}, key_b {kind}, most_days long, days long, correlation double"
    return placed.groupBy("part").cogroup(members.groupBy("of")).applyInPandas(check, kinds)


Series = tuple[np.ndarray, np.ndarray]


def _correlations(left: list[Series], right: list[Series], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common days, and correlation over them, of the series ``left[a]`` and ``right[b]``; days may repeat."""
    calendar = np.unique(np.concatenate([at for at, _ in left + right]))

    def dense(series: list[Series]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per series and day of the calendar: rows, sum and sum of squares about the median."""
        place = np.concatenate([i * len(calendar) + np.searchsorted(calendar, at) for i, (at, _) in enumerate(series)])
        value = np.concatenate([v - np.median(v) for _, v in series])
        size = len(series) * len(calendar)
        return tuple(np.bincount(place, w, size).reshape(len(series), -1) for w in (np.ones(len(value)), value, value * value))

    (m, s, q), (n, t, u) = dense(left), dense(right)
    days, x, y, xx, yy, xy = ((p @ r.T)[a, b] for p, r in ((m, n), (s, n), (m, t), (q, n), (m, u), (s, t)))
    var_x, var_y = days * xx - x * x, days * yy - y * y
    with np.errstate(divide="ignore", invalid="ignore"):
        found = (days * xy - x * y) / np.sqrt(var_x * var_y)
    found[(days < 2) | (xx == 0) | (yy == 0)] = np.nan
    # Where nearly all of a sum is lost in the difference, a pair is computed on its own.
    for i in np.nonzero((days > 1) & ((var_x <= 1e-9 * days * xx) | (var_y <= 1e-9 * days * yy)))[0]:
        both = pd.DataFrame(dict(zip(("at", "x"), left[a[i]], strict=True))).merge(pd.DataFrame(dict(zip(("at", "y"), right[b[i]], strict=True))), "inner", "at")
        own, other = (both[c] - both[c].iloc[0] for c in "xy")
        own, other = own - own.mean(), other - other.mean()
        found[i] = (own * other).sum() / np.sqrt((own * own).sum() * (other * other).sum()) if own.any() and other.any() else np.nan
    return days.astype(np.int64), found


def correlated_pairs(
    returns: DataFrame,
    threshold: float,
    spec: PanelSpec = PanelSpec(),
    ret: str = "daily_return",
    overlap: float = 0.9,
    recall: float = 0.999,
) -> DataFrame:
    """Pairs ``key_a < key_b`` whose returns correlate by ``threshold`` at least over their common days.

    Both series have ``overlap`` of the longer one's days in common.  Candidates are series that share a band of
    signs of random projections; a pair at the threshold is one with the probability ``recall``, one above it
    with a greater probability.  Bands get longer with the number of series, so that a series meets about as many
    unrelated ones whatever the panel, and the signs of all bands sort these out.  Every candidate left is checked on
    the returns.  Series whose returns don't vary correlate with none.
    """
    if not 0 < threshold <= 1 or not 0 < overlap <= 1:
        raise ValueError("threshold and overlap are positive shares")
    n = returns.select(spec.key).distinct().count()
    bits = min(30, max(8, math.ceil(math.log2(max(n, 2))) - 11))
    bands = bands_needed(threshold, overlap, bits, recall)
    sketches = stored(return_sketches(returns, bands, bits, spec, ret), "sketches")
    pairs = stored(candidate_pairs(sketches, overlap, most_signs_apart(threshold, overlap, bands * bits)), "candidate-pairs")
    checked = checked_pairs(sketches, pairs)
    enough = (F.col("days") >= F.col("most_days") * overlap) & F.col("correlation").between(threshold, 2.0)
    return stored(checked.filter(enough).drop("most_days"), "correlated-pairs")
