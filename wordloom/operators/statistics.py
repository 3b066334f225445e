"""Frequency distributions: shares, Zipf's law and information measures."""

from __future__ import annotations

from math import exp, factorial, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.ranks import ranked


def _by_frequency() -> list[Column]:
    return [F.desc("frequency"), F.col("wordform")]


def running_shares(frequencies: DataFrame) -> DataFrame:
    """Words by falling frequency with rank, running sum and running share."""
    rows = ranked(
        frequencies.select("wordform", "frequency"), _by_frequency(),
        running={"running_sum": "frequency"})
    total = frequencies.agg(F.sum("frequency")).scalar()
    return rows.withColumn("running_share", F.try_divide(F.col("running_sum"), total))


def list_differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """How many words a step removed and added; always two rows."""
    old, new = before.select("wordform").distinct(), after.select("wordform").distinct()

    def counted(change: str, words: DataFrame) -> DataFrame:
        return words.agg(F.count(F.lit(1)).alias("num_words")).select(
            F.lit(change).alias("change"), "num_words")

    return counted("removed", old.join(new, "wordform", "left_anti")).unionByName(
        counted("added", new.join(old, "wordform", "left_anti")))


def expected_share(rank: Column, normalization: Column, q: float = 0, s: float = 1) -> Column:
    """Zipf-Mandelbrot share of a rank; q = 0 is Zipf's law.

    The normalization is the sum of 1/rank^s, also when q shifts the ranks.
    """
    return F.lit(1.0) / F.pow(rank + F.lit(float(q)), F.lit(float(s))) / normalization


def zipf(frequencies: DataFrame, q: float = 0, s: float = 1) -> DataFrame:
    """Observed and expected frequency of every word, and what the law leaves unexplained.

    `residual` is 1 - observed/expected.
    """
    rows = ranked(frequencies.select("wordform", "frequency"), _by_frequency())
    total = frequencies.agg(F.sum("frequency")).scalar()
    normalization = rows.agg(
        F.sum(F.lit(1.0) / F.pow("rank", F.lit(float(s))))).scalar()
    expected = total * expected_share(F.col("rank"), normalization, q, s)
    return rows.withColumn("expected", expected).withColumn(
        "residual", 1 - F.try_divide(F.col("frequency"), F.col("expected")))


def entropy(frequencies: DataFrame) -> DataFrame:
    """Shannon entropy in bits; words without occurrences add nothing."""
    counts, total = _shares(frequencies)
    p = F.col("frequency") / total
    return counts.agg((-F.sum(F.col("n") * p * F.log2(p))).alias("entropy"))


def _shares(frequencies: DataFrame) -> tuple[DataFrame, Column]:
    """(frequency, number of words with it) for positive frequencies, and the total."""
    counts = frequencies.filter(F.col("frequency") > 0).groupBy("frequency").agg(
        F.count(F.lit(1)).alias("n"))
    return counts, frequencies.agg(F.sum("frequency")).scalar()


def kl_grid(
    frequencies: DataFrame, qs: tuple[float, ...], ss: tuple[float, ...],
) -> DataFrame:
    """(q, s, kl): divergence in bits of the data from the law, for a grid of parameters.

    The divergence splits into a sum per q, a sum per s and the entropy, so one pass over the
    ranked words gives the whole grid.
    """
    rows = ranked(frequencies.select("wordform", "frequency"), _by_frequency())
    total = frequencies.agg(F.sum("frequency")).scalar()
    rows = rows.withColumn("p", F.col("frequency") / total)
    p = F.when(F.col("frequency") > 0, F.col("p"))
    sums = rows.agg(
        F.sum(p * F.log2(p)).alias("plogp"),
        *[F.sum(p * F.log2(F.col("rank") + F.lit(float(q)))).alias(f"q{i}")
          for i, q in enumerate(qs)],
        *[F.sum(F.lit(1.0) / F.pow("rank", F.lit(float(s)))).alias(f"s{j}")
          for j, s in enumerate(ss)],
    )
    return sums.select(F.inline(F.array(*[
        F.struct(
            F.lit(float(q)).alias("q"), F.lit(float(s)).alias("s"),
            (F.col("plogp") + F.lit(float(s)) * F.col(f"q{i}") + F.log2(F.col(f"s{j}")))
            .alias("kl"),
        )
        for i, q in enumerate(qs) for j, s in enumerate(ss)
    ])))


def kl_divergence(frequencies: DataFrame, q: float = 0, s: float = 1) -> DataFrame:
    return kl_grid(frequencies, (q,), (s,))


def fit_zipf(frequencies: DataFrame, qs: tuple[float, ...], ss: tuple[float, ...]) -> DataFrame:
    """The grid point with the smallest divergence; of equals the smallest q, then s."""
    best = F.min(F.struct("kl", "q", "s")).alias("b")
    return kl_grid(frequencies, qs, ss).agg(best).select("b.q", "b.s", "b.kl")


#: Ranks up to here are bins of their own; above, a bin is 1/32 wide in the logarithm of the rank.
OWN_BINS, BINS_PER_UNIT = 64, 32
#: Powers of the deviations within a bin; with s up to 60 the sums are right to about 1e-9.
MOMENTS = 8
STEEPEST = 60.0


def rank_histogram(frequencies: DataFrame) -> DataFrame:
    """`(centre, m0 .. m8, p, plogp)`: ranks by falling frequency in bins of their logarithm.

    `centre` is the natural logarithm in the middle of a bin, `mk` the sum of the k-th powers of
    the deviations from it, `p` the sum of shares times log2(rank), `plogp` of shares times their
    log2.  There are 32 bins to each factor of e, so some 1,000 rows for any number of words; all
    columns are sums, formed before the shuffle.
    """
    rows = ranked(frequencies.select("wordform", "frequency"), _by_frequency())
    total = frequencies.agg(F.sum("frequency")).scalar()
    start = log(OWN_BINS)
    x = F.log(F.col("rank"))
    step = F.floor((x - start) * BINS_PER_UNIT).cast("int")
    share = F.when(F.col("frequency") > 0, F.col("frequency") / total)
    rows = rows.select(
        x.alias("x"), share.alias("share"),
        F.when(F.col("rank") <= OWN_BINS, x).otherwise(
            start + (step + 0.5) / BINS_PER_UNIT).alias("centre"))
    off = F.col("x") - F.col("centre")
    return rows.groupBy("centre").agg(
        *[F.sum(F.pow(off, F.lit(float(k)))).alias(f"m{k}") for k in range(MOMENTS + 1)],
        F.coalesce(F.sum(F.col("share") * F.col("x") / log(2)), F.lit(0.0)).alias("p"),
        F.coalesce(F.sum(F.col("share") * F.log2("share")), F.lit(0.0)).alias("plogp"))


def best_zipf(frequencies: DataFrame) -> DataFrame:
    """`(q, s, kl)`: the parameters, both 0 or more, with the smallest divergence in bits.

    A larger q only adds to the divergence, so the best one is 0, and the divergence is convex in
    s: Newton's method, kept within a bracket, on the sums of `rank_histogram`.  No row without an
    occurrence.  If one of several words has all occurrences, every larger s is better, and s is
    the steepest tried, 60.
    """
    spark = frequencies.sparkSession
    bins = rank_histogram(frequencies).collect()
    aim = sum(b["p"] for b in bins)
    plogp = sum(b["plogp"] for b in bins)

    def sums(s: float) -> tuple[float, float, float]:
        """Sums over all ranks of rank^-s, and the mean and variance of ln(rank) under it."""
        zero = one = two = 0.0
        for b in bins:
            m, c = [b[f"m{k}"] for k in range(MOMENTS + 1)], b["centre"]
            weights = [(-s) ** k / factorial(k) for k in range(MOMENTS + 1)]

            def moment(j: int) -> float:
                return sum(w * v for w, v in zip(weights, m[j:]))

            scale, (a, d, e) = exp(-s * c), map(moment, range(3))
            zero += scale * a
            one += scale * (c * a + d)
            two += scale * (c * c * a + 2 * c * d + e)
        return zero, one / zero, max(two / zero - (one / zero) ** 2, 0.0)

    def slope(s: float) -> tuple[float, float]:
        _, mean, variance = sums(s)
        return aim * log(2) - mean, variance

    if not any(b["plogp"] or b["p"] for b in bins) and (
            frequencies.filter(F.col("frequency") > 0).isEmpty()):
        return spark.createDataFrame([], "q double, s double, kl double")
    low, high, s = 0.0, STEEPEST, 1.0
    if slope(0.0)[0] > -1e-12:
        s = high = 0.0
    elif slope(high)[0] < 0:
        s = low = high
    for _ in range(100):
        if high - low < 1e-12:
            break
        rise, curve = slope(s)
        low, high = (low, s) if rise > 0 else (s, high)
        new = s - rise / curve if curve > 0 else low
        new = new if low < new < high else (low + high) / 2
        if abs(new - s) < 1e-12:
            break
        s = new
    kl = plogp + s * aim + log2(sums(s)[0])
    return spark.createDataFrame([(0.0, s, kl)], "q double, s double, kl double")
