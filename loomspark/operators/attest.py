"""Attested computations: bind declared parameters, execute, keep a receipt, attest it, decide."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_NAME = re.compile(r":([A-Za-z_]\w*)")


class UndeclaredParameter(ValueError):
    """A parameter that the contract does not declare, or a required one that is missing."""


def bind(sql: str, declared: Mapping[str, bool], given: Mapping[str, object]) -> dict[str, object]:
    """The parameters to run `sql` with. declared: name -> required. Refuses undeclared names and missing required ones."""
    unknown, missing = set(given) - set(declared), {n for n, required in declared.items() if required and n not in given}
    if unknown or missing:
        raise UndeclaredParameter(f"undeclared: {sorted(unknown)}, missing: {sorted(missing)}")
    return {n: given.get(n) for n in declared if n in _NAME.findall(sql)}


def bound_text(sql: str, args: Mapping[str, object]) -> str:
    """The statement with its parameters written out, as receipts hold it."""
    literal = lambda v: "NULL" if v is None else f"'{str(v).replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)
    return _NAME.sub(lambda m: literal(args[m[1]]) if m[1] in args else m[0], sql)


def execute(spark: SparkSession, sql: str, args: Mapping[str, object]) -> DataFrame:
    """Runs a contract's statement with named parameters."""
    return spark.sql(sql, args=dict(args))


def verdicts(receipts: DataFrame, recomputed: DataFrame, contracts: DataFrame, today: str) -> DataFrame:
    """(name, run_id, verdict): pass, sql_mismatch, value_mismatch or stale for each receipt; none is dropped.

    receipts: name, run_id, executed_sql, value; recomputed: name, bound_sql, actual; contracts: name, stale_after (date).
    A receipt without a contract or recomputation is a sql_mismatch.
    """
    df = receipts.join(recomputed, "name", "left").join(contracts, "name", "left")
    same = F.abs(F.col("value") - F.col("actual")) <= 1e-6 * F.greatest(F.lit(1.0), F.abs("actual"))
    verdict = F.when(~F.coalesce(F.col("executed_sql") == F.col("bound_sql"), F.lit(False)), "sql_mismatch").when(~F.coalesce(same, F.lit(False)), "value_mismatch")
    return df.select("name", "run_id", verdict.when(F.coalesce(F.lit(today).cast("date") >= F.col("stale_after"), F.lit(False)), "stale").otherwise("pass").alias("verdict"))
