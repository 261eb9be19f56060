"""Text formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plansift.functions.numeric import col, round_half_even


def feet_inches(inches: Column | str) -> Column:
    """``68.0 -> 5'-8"`` with a carry when the inches round to 12."""
    value = col(inches)
    feet = F.floor(value.cast("long") / 12).cast("long")
    rest = round_half_even(value - feet * 12).cast("long")
    carry = rest == 12
    return F.format_string(
        "%d'-%d\"",
        F.when(carry, feet + 1).otherwise(feet),
        F.when(carry, F.lit(0).cast("long")).otherwise(rest),
    )
