"""Variant comparison: A/B means, paired differences, verdicts and winners."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


C = F.col


def variant_means(df: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means per variant; zero and missing values do not count, no value gives 0."""
    return df.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(C(m) != 0, C(m))), F.lit(0.0)).alias(f"avg_{m}") for m in metrics]
    )


def paired_frames(original: DataFrame, a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Frames present in the original and in both variants; variant columns keep their names."""
    return original.join(a, list(keys)).join(b, list(keys))


def metric_difference(pairs: DataFrame, keys: Sequence[str], psnr_margin: float = 0.5, ssim_margin: float = 0.01) -> DataFrame:
    """Mean differences B - A and counts of clear improvements and regressions."""
    aggs = []
    for m, margin in (("psnr", psnr_margin), ("ssim", ssim_margin)):
        a, b = C(f"a_{m}"), C(f"b_{m}")
        aggs += [
            (F.avg(b) - F.avg(a)).alias(f"{m}_diff"),
            F.count(F.when(b > a + margin, 1)).alias(f"{m}_improvements"),
            F.count(F.when(a > b + margin, 1)).alias(f"{m}_regressions"),
        ]
    return pairs.groupBy(*keys).agg(*aggs)


def verdict(psnr_diff: Column, psnr_sig: Column, ssim_diff: Column, ssim_sig: Column, vmaf_diff: Column) -> tuple[Column, Column]:
    """(winner, confidence) from significant differences, weights .4 / .4 / .2."""

    def vote(diff: Column, margin: float, weight: float) -> Column:
        return F.when(diff > margin, weight).when(diff < -margin, -weight).otherwise(0.0)

    terms = [(psnr_sig, vote(psnr_diff, 0.5, 0.4), 0.4), (ssim_sig, vote(ssim_diff, 0.01, 0.4), 0.4), (vmaf_diff.isNotNull(), vote(vmaf_diff, 2, 0.2), 0.2)]
    score = sum((F.when(on, v).otherwise(0.0) for on, v, _ in terms), F.lit(0.0))
    weight = sum((F.when(on, w).otherwise(0.0) for on, _, w in terms), F.lit(0.0))
    winner = F.when(weight == 0, "tie").when(score > 0.1, "B").when(score < -0.1, "A").otherwise("tie")
    return winner, F.when(weight == 0, 0.0).otherwise(F.abs(score) / weight)


def winners(variants: DataFrame, keys: Sequence[str], name: str, position: str) -> DataFrame:
    """Winner per metric, by votes and overall; the first inserted variant wins ties."""
    score = C("avg_psnr") / 50 * 0.2 + C("avg_ssim") * 0.3 + C("avg_vmaf") / 100 * 0.3 + C("votes") / 10 * 0.2

    def best(metric: Column) -> Column:
        return F.max_by(C(name), F.struct(metric, -C(position)))

    return variants.groupBy(*keys).agg(
        best(C("avg_psnr")).alias("winner_by_psnr"),
        best(C("avg_ssim")).alias("winner_by_ssim"),
        best(C("avg_vmaf")).alias("winner_by_vmaf"),
        F.when(F.max("votes") > 0, best(C("votes"))).alias("winner_by_votes"),
        best(score).alias("overall_winner"),
    )
