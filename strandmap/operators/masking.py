"""Channel masks: reasons, acceptance, wildcards and status words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Reason codes of masked channels; fixed values.
REASONS = {1: "mask file", 2: "NaN in channel", 3: "variance too high", 4: "correlation too high", 50: "chi2 above 5", 60: "system temperature too high", 70: "system temperature is NaN"}
#: What a rejected sideband adds to the reason of its channels; fixed value.
SIDEBAND = 15


def channel_reasons(tod: DataFrame, channel: list[str], value: str) -> DataFrame:
    """ok and reason by channel: any NaN gives reason 2; a channel of zeros alone is masked with reason 0."""
    bad, zero = F.max(F.isnan(value).cast("int")), F.bool_and(F.col(value) == 0)
    got = tod.groupBy(*channel).agg(bad.alias("_nan"), zero.alias("_zero"))
    return got.select(*channel, (~((F.col("_nan") == 1) | F.col("_zero"))).alias("ok"), F.when(F.col("_nan") == 1, 2).otherwise(0).alias("reason"))


def accept_sidebands(mask: DataFrame, sideband: list[str], least: float) -> DataFrame:
    """Masks whole sidebands of which less than ``least`` is ok; what was still ok gets SIDEBAND added to its reason."""
    rate = F.avg(F.col("ok").cast("double")).over(Window.partitionBy(*sideband))
    mask = mask.withColumn("_r", rate)
    out = F.col("_r") < least
    return mask.withColumn("reason", F.when(out & F.col("ok"), F.col("reason") + SIDEBAND).otherwise(F.col("reason"))).withColumn("ok", F.col("ok") & ~out).drop("_r")


def cut(mask: DataFrame, condition: Column, reason: int) -> DataFrame:
    """Masks channels by a condition; the last rule that fires names the reason."""
    hit = F.coalesce(condition, F.lit(False))
    return mask.withColumn("reason", F.when(hit, reason).otherwise(F.col("reason"))).withColumn("ok", F.col("ok") & ~hit)


def low_resolution(mask: DataFrame, keys: list[str], freq: str, factor: int) -> DataFrame:
    """A coarse channel is ok if any of its fine channels is."""
    return mask.groupBy(*keys, F.floor(F.col(freq) / factor).alias(freq)).agg(F.bool_or("ok").alias("ok"))


def status_word(flags: dict[int, Column]) -> Column:
    """A 64-bit word with the given bits set where their conditions hold."""
    out = F.lit(0).cast("long")
    for bit, c in flags.items():
        out = out.bitwiseOR(F.when(F.coalesce(c, F.lit(False)), F.lit(1 << bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return out


def cut_summary(df: DataFrame, keys: list[str], word: str, bits: int) -> DataFrame:
    """By bit: rows with it set, and rows that survive all bits up to it."""
    upto = lambda b: F.pow(F.lit(2), b + 1).cast("long") - 1
    each = lambda b: F.struct(b.alias("bit"), F.getbit(F.col(word), b).alias("hit"), (F.col(word).bitwiseAND(upto(b)) == 0).alias("left"))
    rows = F.explode(F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), each))
    return df.select(*keys, rows.alias("r")).groupBy(*keys, "r.bit").agg(F.sum(F.col("r.hit").cast("long")).alias("cut"), F.count_if("r.left").alias("survivors"))


def fraction_cut(df: DataFrame, keys: list[str], bad: Column, most: float) -> DataFrame:
    """Groups in which more than a share ``most`` is bad, flagged."""
    return df.groupBy(*keys).agg(F.avg(bad.cast("double")).alias("share")).withColumn("reject", F.col("share") > most)


def chi2_sigma(value: Column, sigma: Column) -> Column:
    """(sum of (value / sigma)^2 - n) / sqrt(2 n)."""
    n = F.count(value)
    return (F.sum(value * value / (sigma * sigma)) - n) / F.sqrt(2 * n)
