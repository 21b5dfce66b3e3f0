"""Money in micro-units as whole numbers: a million micros are one VND. Prices are per million tokens, so a token costs as many micros."""

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS = 1_000_000


def cost_micros(tokens_in: Column, tokens_out: Column, price_in: Column | int, price_out: Column | int) -> Column:
    """Never below zero."""
    price_in = price_in if isinstance(price_in, Column) else F.lit(price_in)
    price_out = price_out if isinstance(price_out, Column) else F.lit(price_out)
    return F.greatest(F.lit(0).cast("long"), (tokens_in * price_in + tokens_out * price_out).cast("long"))


def decimal_string(micros: Column) -> Column:
    """Micros as a decimal number without trailing zeros; the sign is kept."""
    size = F.abs(micros)
    whole = F.floor(size / F.lit(MICROS).cast("decimal(20,0)")).cast("long")
    rest = F.rtrim(F.lpad((size % MICROS).cast("string"), 6, "0"), F.lit("0"))
    sign = F.when(micros < 0, "-").otherwise("")
    return F.concat(sign, whole.cast("string"), F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))


def rounded_vnd(micros: Column) -> Column:
    """Whole VND, halves away from zero."""
    units = F.floor((F.abs(micros) + MICROS // 2) / F.lit(MICROS).cast("decimal(20,0)")).cast("long")
    return F.when(micros < 0, -units).otherwise(units)


def payload(micros: Column) -> Column:
    return F.struct(F.lit("VND").alias("currency"), micros.alias("micros"), decimal_string(micros).alias("amount"), rounded_vnd(micros).alias("rounded"))


def budget_percent(cost: Column, budget: Column) -> Column:
    return F.floor(cost * 100 / budget.cast("decimal(20,0)")).cast("long")


def budget_state(percent: Column, warn: int = 70, alert: int = 85, stop: int = 100) -> Column:
    return F.when(percent >= stop, "hard_stop").when(percent >= alert, "alert").when(percent >= warn, "warn").otherwise("ok")
