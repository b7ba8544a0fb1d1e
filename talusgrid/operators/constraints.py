"""Constraints on tables: a report of every rule's violations, and writes that watch them as they go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from talusgrid.sources import tables

from .events import canonical_line


def present(column: str) -> Column:
    """A rule: the value isn't null."""
    return F.col(column).isNotNull()


def lines(parts: str) -> Column:
    """A rule: a geometry of one line or more, each of two points or more with finite coordinates."""

    def sound(line: Column) -> Column:
        return (F.size(line) >= 2) & F.forall(line, lambda p: _finite(p["x"]) & _finite(p["y"]))

    return (F.size(parts) > 0) & F.forall(parts, sound)


def _finite(value: Column) -> Column:
    return F.coalesce(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), F.lit(False))


def json_list(column: str) -> Column:
    """A rule: the text is a JSON array."""
    return F.schema_of_variant(F.try_parse_json(column)).startswith("ARRAY")


def _broken(rule: Column) -> Column:
    """Rules that give null are broken."""
    return ~F.coalesce(rule, F.lit(False))


def violations(
    df: DataFrame, rules: dict[str, Column], order: str, unique: tuple[str, ...] = (), one_shape: dict[str, str] | None = None
) -> DataFrame:
    """``rule, n_rows, first_row``: how many rows break each rule, and the least ``order`` of them (null if none does).

    ``rules`` are conditions that every row has to meet. Values of the columns
    in ``unique`` may be there once (rule ``unique <column>``; nulls are free;
    all rows of a repeated value count), and all rows of one key in
    ``one_shape`` have to hold the same lines in its geometry column (rule
    ``one shape <key>``). Keys are counted by aggregates that combine before
    they shuffle, so a key that a third of all rows share costs no more than
    others. Without rules, ValueError.
    """
    parts = []
    if rules:
        found = [F.struct(F.lit(n).alias("rule"), _broken(r).alias("bad")) for n, r in rules.items()]
        each = df.select(F.col(order).alias("_o"), F.explode(F.array(*found)).alias("_r"))
        parts.append(each.groupBy(F.col("_r.rule").alias("rule")).agg(F.count_if("_r.bad").alias("n_rows"), F.min(F.when(F.col("_r.bad"), F.col("_o"))).alias("first_row")))
    for column in unique:
        groups = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("o"))
        parts.append(_totals(f"unique {column}", groups, F.col("n") > 1))
    for key, shape in (one_shape or {}).items():
        digest = F.sha1(F.to_json(canonical_line(F.col(shape))))
        groups = df.where(F.col(key).isNotNull()).select(key, F.col(order).alias("_o"), digest.alias("_d")).groupBy(key).agg(
            F.count("*").alias("n"), F.min("_o").alias("o"), (F.min("_d") != F.max("_d")).alias("_more")
        )
        parts.append(_totals(f"one shape {key}", groups, F.coalesce("_more", F.lit(False))))
    if not parts:
        raise ValueError("no rules")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _totals(name: str, groups: DataFrame, bad: Column) -> DataFrame:
    return groups.agg(F.coalesce(F.sum(F.when(bad, F.col("n"))), F.lit(0)).alias("n_rows"), F.min(F.when(bad, F.col("o"))).alias("first_row")).select(
        F.lit(name).alias("rule"), "n_rows", "first_row"
    )


def write_checked(df: DataFrame, path: str, rules: dict[str, Column], order: str) -> DataFrame:
    """``df`` as Parquet at ``path``, read back; its rules are counted by the job that writes it.

    If rows break a rule, what was written is deleted and ValueError names each
    such rule, its number of rows and the first of them by ``order``.
    """
    if not rules:
        raise ValueError("no rules")
    watch, metrics = Observation(), []
    for k, rule in enumerate(rules.values()):
        bad = _broken(rule)
        metrics += [F.count_if(bad).alias(f"n{k}"), F.min(F.when(bad, F.col(order))).alias(f"first{k}")]
    df.observe(watch, *metrics).write.mode("overwrite").parquet(path)
    got = watch.get
    broken = [f"{name}: {got[f'n{k}']} rows, first {got[f'first{k}']}" for k, name in enumerate(rules) if got[f"n{k}"]]
    if broken:
        tables.delete(df.sparkSession, path)
        raise ValueError("; ".join(broken))
    return df.sparkSession.read.schema(df.schema).parquet(path)
