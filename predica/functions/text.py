"""Text of numbers as rules see it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(col: Column) -> Column:
    """A double as plans.ir.plain_number() writes it: shortest digits, never scientific, no trailing zeros; null is null.

    The digits are the JVM's, which writes one digit too many for some numbers before Java 19 (as 4.9E-324).
    """
    x = col.cast("double")
    text = F.abs(x).cast("string")
    mantissa, exponent = F.substring_index(text, "E", 1), F.coalesce(F.nullif(F.regexp_extract(text, r"E(-?\d+)$", 1), F.lit("")).cast("int"), F.lit(0))
    left, right = F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")
    digits, point = F.concat(left, right), F.char_length(left) + exponent
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), F.regexp_replace(digits, "^0+", ""))
    whole = F.rpad(digits, F.greatest(point, F.lit(1)), "0")
    mixed = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.lit(400)))
    plain = F.when(x == 0, F.lit("0")).when(point <= 0, small).when(point >= F.char_length(digits), whole).when(left == "0", mantissa).otherwise(mixed)
    negative = (x < 0) | ((x == 0) & F.startswith(x.cast("string"), F.lit("-")))
    signed = F.when(negative, F.concat(F.lit("-"), plain)).otherwise(plain)
    return F.when(F.isnan(x), F.lit("NaN")).when(x == float("inf"), F.lit("+Inf")).when(x == float("-inf"), F.lit("-Inf")).otherwise(signed)
