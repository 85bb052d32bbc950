"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], salts: int = 16, how: str = "left") -> DataFrame:
    """Equality join of a large ``left`` whose keys may be hot with a ``right`` that has one row a key.

    Every row of ``left`` goes to one of ``salts`` shares of its key, chosen by a hash of its columns
    ``by``; ``right`` is repeated for each share. No key brings more than 1/salts of its rows to
    one task, whatever its share of the table. Keys must not be null (such rows find nothing).
    It is a merge join: Spark knows the size of ``right`` before it is repeated, and might send ``salts`` times what it means to.
    """
    salt = "__pw_salt"
    left = left.withColumn(salt, F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right.hint("merge"), [*keys, salt], how).drop(salt)
