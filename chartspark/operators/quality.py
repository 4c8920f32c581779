"""Data-quality checks as DataFrames of counted violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASS, FAIL, INFO = "PASS", "FAIL", "info"


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows, distinct keys and surplus rows of a key."""
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_keys")
    ).withColumn("n_duplicates", F.col("n_rows") - F.col("n_keys"))


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows; raises when a key repeats. Checked by one aggregate."""
    surplus = duplicate_count(df, keys).first()["n_duplicates"]
    if surplus:
        raise ValueError(f"{surplus} duplicate keys on {keys}")
    return df


def checked_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", one_to_one: bool = False) -> DataFrame:
    """Join that refuses a repeated key on the right (and on the left for one-to-one)."""
    require_unique(right, keys)
    if one_to_one:
        require_unique(left, keys)
    return left.join(right, keys, how)


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations): rows where the rule is false or unknown, all rules in one pass."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    cells = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules])
    return counts.select(F.explode(cells).alias("c")).select("c.rule", "c.violations")


def check_log(counts: DataFrame, scope: str, name: str = "rule", value: str = "violations") -> DataFrame:
    """Counted violations as PASS/FAIL rows."""
    return counts.select(
        F.col(name).alias("check"),
        F.lit(scope).alias("scope"),
        F.when(F.col(value) == 0, PASS).otherwise(FAIL).alias("status"),
        F.col(value).cast("bigint").alias("value"),
        F.lit(0).cast("bigint").alias("expected"),
    )


def not_null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return rule_violations(df, {c: F.col(c).isNotNull() for c in columns})


def orphan_keys(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct child keys without parent."""
    return child.select(*keys).distinct().join(parent.select(*keys).distinct(), keys, "left_anti")


def reference_progress(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys, matched keys and percentage."""
    known = parent.select(*keys).distinct().withColumn("_hit", F.lit(1))
    flagged = child.select(*keys).distinct().join(known, keys, "left")
    return flagged.agg(
        F.count(F.lit(1)).alias("n_keys"), F.count("_hit").alias("n_matched")
    ).withColumn("progress_pct", F.round(F.col("n_matched") / F.col("n_keys") * 100, 4))


def disjoint_union_report(a: DataFrame, b: DataFrame, key: str, value: str, low: float, high: float) -> DataFrame:
    """Union of two tables that must not share keys, with its checks as one row."""
    both = a.withColumn("_side", F.lit(1)).unionByName(b.withColumn("_side", F.lit(2)))
    per_key = both.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("_side").alias("sides"),
        F.count_if(F.col(value).isNull()).alias("nulls"),
        F.count_if(~F.col(value).between(low, high)).alias("outside"),
    )
    return per_key.agg(
        F.sum("n").alias("n_rows"), F.count_if(F.col("sides") > 1).alias("overlap"),
        F.sum("nulls").alias("nulls"), F.sum("outside").alias("outside"),
    )


def disjoint_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Union that raises when the tables share a key."""
    if a.select(key).join(b.select(key), key, "left_semi").limit(1).count():
        raise ValueError(f"the tables share values of {key}")
    return a.unionByName(b)


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], columns: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Full outer comparison: side of each key and, for shared keys, which columns differ. NULL equals NULL."""
    left = a.select(*keys, *[F.col(c).alias(f"{c}_a") for c in columns], F.lit(True).alias("_in_a"))
    right = b.select(*keys, *[F.col(c).alias(f"{c}_b") for c in columns], F.lit(True).alias("_in_b"))
    both = left.join(right, keys, "full_outer")
    side = F.when(F.col("_in_a").isNull(), "only_second").when(F.col("_in_b").isNull(), "only_first").otherwise("both")
    types = dict(a.dtypes)
    differs = []
    for c in columns:
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        if types[c] in ("double", "float"):
            same = F.when(x.isNull() | y.isNull(), x.isNull() & y.isNull()).otherwise(F.abs(x - y) <= tolerance)
        else:
            same = x.eqNullSafe(y)
        differs.append(F.when(~same, F.lit(c)))
    changed = F.when(side == "both", F.array_compact(F.array(*differs))).otherwise(F.array().cast("array<string>"))
    return both.select(*keys, side.alias("side"), changed.alias("different"))


def tolerance_checks(actual: DataFrame, expected: DataFrame, atol: float = 1e-7, rtol: float = 1e-5) -> DataFrame:
    """(label, actual, expected, status) for every expected value; a missing actual value fails."""
    joined = expected.join(actual, "label", "left")
    close = F.abs(F.col("actual") - F.col("expected")) <= F.lit(atol) + F.lit(rtol) * F.abs(F.col("expected"))
    return joined.select(
        "label", "actual", "expected", F.when(F.coalesce(close, F.lit(False)), PASS).otherwise(FAIL).alias("status")
    )
