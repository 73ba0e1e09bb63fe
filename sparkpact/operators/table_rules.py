"""Membership in a column of a table: lists of any size, which no plan could hold as literals.

The rule's verdict on a row is a Boolean column that the engine joins to the frame before it compiles the contract. The list is
made distinct and joined once per rule: broadcast where its size has been checked, else by a shuffle whose hot values are
dealt over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field as plain
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ContractError
from ..functions.values import Val, kind_of
from .rule import Rule

#: Lists of at most so many bytes (16 a value and the text itself) are broadcast.
BROADCAST_BYTES = 32 << 20
#: A value that more than one row in so many has is hot, and is dealt over ``SALTS`` tasks.
HOT_SHARE, SALTS = 2_000, 64
_KINDS = {"string": "string", "number": "double", "boolean": "boolean", "date": "timestamp"}
_numbers = count()


@dataclass(frozen=True, eq=False)
class TableRule(Rule):
    """A rule whose verdict comes from a join. verdict: the name of the joined column."""

    values: DataFrame | None = None
    kind: str = "string"
    verdict: str = plain(default="")


def _table_rule(name: str, df: DataFrame, column: str, wanted: bool) -> Rule:
    kind = kind_of(df.schema[column].dataType)
    if kind not in _KINDS:
        raise ContractError(f"{name}: a list can't be of type {df.schema[column].dataType.simpleString()}")
    values = df.select(F.col(f"`{column}`").cast(_KINDS[kind]).alias("v")).where("v IS NOT NULL")
    if kind == "number":  # a list finds NaN, but -0 is 0
        values = values.select((F.col("v") + F.lit(0.0)).alias("v"))
    verdict = f"__in_table_{next(_numbers)}"

    def test(v: Val) -> Column:
        hit = F.coalesce(F.col(verdict), F.lit(False))
        return hit if wanted else ~hit

    return TableRule(name, test, constraints={"column": column}, values=values, kind=kind, verdict=verdict)


def is_in_table(df: DataFrame, column: str) -> Rule:
    """isIn for a table's column. Nulls of the column are no values: a null or missing value is in no table."""
    return _table_rule("isIn", df, column, True)


def is_not_in_table(df: DataFrame, column: str) -> Rule:
    return _table_rule("isNotIn", df, column, False)


def joined(df: DataFrame, rule: TableRule, value: Val) -> DataFrame:
    """df with the rule's verdict: true where the value is in the table, null elsewhere. Rows are neither lost nor repeated."""
    if rule.kind not in value.kinds:
        return df.withColumn(rule.verdict, F.lit(None).cast("boolean"))
    key, values = f"{rule.verdict}_key", rule.values.distinct()
    given = value.get(rule.kind)
    df = df.withColumn(key, given + F.lit(0.0) if rule.kind == "number" else given)
    found = values.select(F.col("v").alias(key), F.lit(True).alias(rule.verdict))
    size = values.agg(F.sum(F.lit(16) + F.coalesce(F.octet_length(F.col("v").cast("string")), F.lit(0)))).first()[0] or 0
    if size <= BROADCAST_BYTES or df.isStreaming:
        return df.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, key, "left").drop(key)
    return _salted(df, found, key).drop(key)


def _salted(df: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Hot values are so few that they can be broadcast; their rows, and those without a value, go to many tasks."""
    salt, bound = f"{key}_salt", df.count() // HOT_SHARE + 1
    hot = df.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > bound).select(key, F.lit(True).alias(f"{key}_hot"))
    hot = F.broadcast(hot)  # at most HOT_SHARE rows
    spread = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    left = df.withColumn(salt, spread).join(hot, key, "left")
    left = left.withColumn(salt, F.when(F.col(f"{key}_hot") | F.col(key).isNull(), F.col(salt)).otherwise(0)).drop(f"{key}_hot")
    right = found.join(hot, key, "left").withColumn(salt, F.explode(F.when(F.col(f"{key}_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop(f"{key}_hot")
    return left.join(right, [key, salt], "left").drop(salt)
