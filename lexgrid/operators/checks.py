"""Validation, roles and cascades: what constraints and policies would do, as transforms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, error) for every rule a row breaks, in one pass; a rule is the condition that makes it an error."""
    found = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules.items()]))
    return rows.select(key, F.explode(found).alias("error"))


def cascade(parent: DataFrame, gone: Column, children: list[tuple[DataFrame, str, str]]) -> list[DataFrame]:
    """Parents without the gone ones, then every child table without rows whose parent is no longer there.

    children: (table, its column, the column of the table before it), outermost first.
    """
    kept = [parent.where(~gone)]
    for child, own, other in children:
        kept.append(child.join(kept[-1].select(F.col(other).alias(own)).distinct(), own, "left_semi"))
    return kept


def role_view(rows: DataFrame, role: str, public: Column) -> DataFrame:
    """Everything for the service role, public rows for anyone else."""
    return rows if role == "service" else rows.where(public)


def union_all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
