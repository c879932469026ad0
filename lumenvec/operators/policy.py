"""Which profile a component gets, what may be reused, and nominal ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW = "raw_exact"
#: Raw for every kind.
CONSERVATIVE: dict[str, tuple[str, ...]] = {k: (RAW,) for k in ("full_attn_k", "full_attn_v", "conv_state", "recurrent_state")}


def resolve(kind: Column, asked: Column, admitted: dict[str, tuple[str, ...]] = CONSERVATIVE, reject_unknown: bool = True) -> Column:
    """struct(profile, reason): what is asked for if its kind admits it, else raw and why; nothing asked for is raw."""
    known = kind.isin(*admitted)
    fits = F.lit(False)
    for name, profiles in admitted.items():
        fits = fits | ((kind == name) & asked.isin(*profiles))
    fits = F.coalesce(fits, F.lit(False))
    profile = F.when(fits, asked).otherwise(RAW)
    why = F.when(~known, F.concat(F.lit("unknown component kind: "), kind) if reject_unknown else F.lit(None).cast("string"))
    why = why.when(asked.isNull() | fits, F.lit(None).cast("string")).otherwise(F.concat(asked, F.lit(" is not admitted for "), kind))
    return F.struct(profile.alias("profile"), why.alias("reason"))


def reusable(status: Column, age: Column, max_age: float) -> Column:
    """Active and young enough."""
    return (status == "Active") & (age <= max_age)


def nominal_ratio(block: Column, words: Column) -> Column:
    """Bits of a block of 32-bit floats over those of its codeword."""
    return block * 32 / F.ceil(F.log2(words))
