"""Small statistical expressions and the additive statistic specification."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def r9(x: Column | str) -> Column:
    """Rounded to nine places, and minus zero made zero, for comparison across engines."""
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c, 9) + F.lit(0.0)


def flag(x: Column) -> Column:
    return F.when(x, 1).otherwise(0)


def share(num: Column, den: Column) -> Column:
    """Undefined, not zero, where the denominator is."""
    return F.when(den != 0, num.cast("double") / den)


@dataclass(frozen=True)
class Rate:
    """A rate as sums of two row expressions, so that it aggregates, rolls up and resamples without Python."""

    name: str
    num: Column
    den: Column

    def sums(self) -> list[Column]:
        return [F.sum(self.num).alias(f"{self.name}_num"), F.sum(self.den).alias(f"{self.name}_den")]

    def value(self) -> Column:
        return share(F.col(f"{self.name}_num"), F.col(f"{self.name}_den")).alias(self.name)


def draw(*parts: Column | str | int) -> Column:
    """A uniform integer below 2**32 from an md5 of the parts: the same in any engine."""
    cols = [F.lit(str(p)) if isinstance(p, (str, int)) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")
