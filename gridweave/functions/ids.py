"""Ids made of contents: the same parts always give the same id."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(x: Column | str) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def stable_id(*parts: Column | str) -> Column:
    """24 hexadecimal digits of the SHA-256 of the parts joined by |. Strings are literals; null counts as empty."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(_column(p).cast("string"), F.lit("")) for p in parts]), 256), 1, 24)


def severity_of(parameter: Column) -> Column:
    from .patterns import CRITICAL_PARAMETERS, WARNING_PARAMETERS

    return F.when(parameter.isin(*CRITICAL_PARAMETERS), "CRITICAL").when(parameter.isin(*WARNING_PARAMETERS), "WARNING").otherwise("INFO")


def severity_rank(severity: Column) -> Column:
    return F.when(severity == "CRITICAL", 0).when(severity == "WARNING", 1).otherwise(2)
