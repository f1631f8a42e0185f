"""Comparison of what sources claim about the same fact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The facts that are compared, and the columns of their statuses.
FACTS = {"capture_time": "s_time", "device_make": "s_make", "device_model": "s_model", "software": "s_software"}


def status(*keys: Column) -> Column:
    """no-data, only-in-one-source, agree or differ, by the keys of all sources that have one."""
    n = sum((k.isNotNull().cast("int") for k in keys[1:]), keys[0].isNotNull().cast("int"))
    least, greatest = (F.least(*keys), F.greatest(*keys))  # of those that aren't null
    return F.when(n == 0, "no-data").when(n == 1, "only-in-one-source").when(least == greatest, "agree").otherwise("differ")


def is_claim(t: Column) -> Column:
    """A capture claim that can be compared."""
    return F.coalesce(t["parseable"], F.lit(False)) & F.coalesce(t["value_utc"], t["wall"]).isNotNull()


def capture_key(t: Column) -> Column:
    """Instants and naive wall times never agree."""
    return F.when(is_claim(t), F.when(t["value_utc"].isNotNull(), F.concat(F.lit("utc:"), t["value_utc"])).otherwise(F.concat(F.lit("naive:"), t["wall"])))


def field_key(c: Column, field: str) -> Column:
    return F.when(c[f"{field}_norm"].isNotNull(), c[f"{field}_key"])


def statuses(stamps: list[Column], claims: list[Column]) -> dict[str, Column]:
    """The status of each fact, from the claims of capture time and of the device."""
    return {"s_time": status(*map(capture_key, stamps)), **{f"s_{f}": status(*(field_key(c, f) for c in claims)) for f in ("make", "model", "software")}}


def facts() -> Column:
    """array<struct<fact, status>> of the statuses' columns."""
    return F.array(*(F.struct(F.lit(fact).alias("fact"), F.col(column).alias("status")) for fact, column in FACTS.items()))


def differs(*names: str) -> Column:
    """Whether one of the named facts, or any, differs."""
    return F.lit("differ").isin(*(F.col(FACTS[n]) for n in names or FACTS))
