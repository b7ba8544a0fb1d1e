"""Cleaning of event tables and of geometries that carry event lists."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose column starts with ``prefix``; null doesn't."""
    return df.where(F.coalesce(F.startswith(F.col(column), F.lit(prefix)), F.lit(False)))


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def combine_events(*columns: str) -> Column:
    """The ``;``-separated entries of several cells as one list, in order.

    Null cells and the texts '', 'nan' and 'None' are no cells; entries are
    stripped and empty ones dropped.
    """
    cells = F.array(*[F.when(~F.col(c).isin("", "nan", "None"), F.col(c)) for c in columns])
    entries = F.flatten(F.transform(F.array_compact(cells), lambda c: F.split(c, ";")))
    return F.filter(F.transform(entries, _strip), lambda x: x != "")


def hash_uuid(digest: Column) -> Column:
    """The first 32 digits of a hexadecimal digest in the form of a UUID."""
    return F.regexp_replace(F.substring(digest, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def merge_duplicates(df: DataFrame, key: str, events: str, order: str, *more: Column) -> DataFrame:
    """One row for each key: lists end to end in row order without repeats.

    ``identical`` says whether all rows of the key had the same set of events.
    ``more`` are further aggregates of the key's rows. Lists of one key are
    gathered: a geometry's rows are few by nature.
    """
    whole = F.array_sort(F.array_distinct(F.col(events)))
    rows = F.array_sort(F.collect_list(F.struct(F.col(order), F.col(events).alias("e"))))
    return df.groupBy(key).agg(
        F.array_distinct(F.flatten(F.transform(rows, lambda r: r["e"]))).alias(events),
        F.count("*").alias("n_rows"),
        (F.min(whole) == F.max(whole)).alias("identical"),
        *more,
    )


def checked_events(*columns: str) -> Column:
    """``combine_events``, which raises for cells that two readings count differently.

    A cell such as ' nan ' is no cell once it is stripped, but an entry before.
    """
    odd = [_strip(F.col(c)).isin("nan", "None") & ~F.col(c).isin("nan", "None") for c in columns]
    bad = F.coalesce(reduce(lambda a, b: a | b, [F.coalesce(o, F.lit(False)) for o in odd]), F.lit(False))
    cells = F.concat_ws("|", *columns)
    return F.when(bad, F.raise_error(F.format_string("entries of '%s' can't be counted", cells))).otherwise(combine_events(*columns))


def canonical_line(parts: Column) -> Column:
    """Lines in the direction whose points come first, lines in order: equal shapes are equal values."""
    one_way = F.transform(parts, lambda line: F.least(line, F.reverse(line)))
    return F.array_sort(one_way)


def geometry_uuid(parts: Column) -> Column:
    """A UUID of a line geometry's canonical points; null and empty geometries have none.

    Two geometries have the same one if and only if they are the same lines,
    whatever the order of the lines and their direction.
    """
    digest = F.sha1(F.to_json(canonical_line(parts)))
    return hash_uuid(F.when(F.size(parts) > 0, digest))


def duplicate_report(df: DataFrame, key: str, events: str) -> DataFrame:
    """Keys of more than one row, null among them: rows, and whether their events are one set."""
    whole = F.array_sort(F.array_distinct(F.col(events)))
    counted = df.groupBy(key).agg(F.count("*").alias("n_rows"), (F.min(whole) == F.max(whole)).alias("identical"))
    return counted.where("n_rows > 1")


def preprocess_geometries(df: DataFrame, columns: list[str], parts: str, order: str) -> DataFrame:
    """``geom_uuid, events, geometry, n_rows``: one row for each geometry, its events in order.

    Raises for a null or empty geometry, for cells that can't be counted, and
    for two different geometries of one UUID.
    """
    missing = F.coalesce(F.size(parts), F.lit(0)) <= 0
    uuid = F.when(missing, F.raise_error(F.format_string("row %s has no geometry", order))).otherwise(geometry_uuid(F.col(parts)))
    rows = df.select(uuid.alias("geom_uuid"), checked_events(*columns).alias("events"), F.col(parts).alias("_parts"), F.col(order).alias("_order"))
    shape = canonical_line(F.col("_parts"))
    merged = merge_duplicates(
        rows, "geom_uuid", "events", "_order", F.min_by("_parts", "_order").alias("geometry"), (F.min(shape) == F.max(shape)).alias("_one")
    )
    clash = F.raise_error(F.format_string("%s stands for two geometries", "geom_uuid"))
    return merged.select(
        "geom_uuid", "events", F.when(F.col("_one"), F.col("geometry")).otherwise(clash).alias("geometry"), "n_rows"
    )


def append_geometries(events: DataFrame, geoms: DataFrame, pk: str, geom_id: str, list_col: str, parts: str) -> DataFrame:
    """Every event with the lines of all geometries whose list has its ``pk``.

    ``n_geometries`` counts them, ``geometry`` holds their lines in order of
    ``geom_id`` (null if there is none) and ``geometry_type`` says whether they
    are one line. Lists are taken apart and lines brought together for each
    key, never for each event, so repeated keys cost nothing.
    """
    member = geoms.select(F.col(geom_id).alias("_g"), F.col(parts).alias("_p"), F.explode(F.array_distinct(list_col)).alias(pk))
    ordered = F.array_sort(F.collect_list(F.struct("_g", "_p")))
    lines = member.groupBy(pk).agg(
        F.count("*").alias("n_geometries"), F.flatten(F.transform(ordered, lambda r: r["_p"])).alias("geometry")
    )
    kind = F.when(F.size("geometry") == 1, "LineString").when(F.size("geometry") > 1, "MultiLineString")
    return events.join(lines, pk, "left").withColumns(
        {"n_geometries": F.coalesce("n_geometries", F.lit(0)), "geometry_type": kind}
    )


def geometry_statistics(df: DataFrame, counts: str = "n_geometries") -> DataFrame:
    """One row: events without, with one and with more geometries, and the most of one event."""
    n = F.col(counts)
    return df.agg(
        F.count("*").alias("n_events"), F.count_if(n == 0).alias("without"), F.count_if(n == 1).alias("with_one"),
        F.count_if(n >= 2).alias("with_more"), F.max(n).alias("most"),
    )


def events_with_geometries(events: DataFrame, geoms: DataFrame, pk: str, geom_id: str, list_col: str) -> DataFrame:
    """Every event with the number of geometries whose list has its ``pk``.

    Lists are taken apart, so it is a hash join on the key, never a comparison
    of every event with every geometry.
    """
    member = geoms.select(geom_id, F.explode(F.array_distinct(list_col)).alias(pk))
    counted = member.groupBy(pk).agg(
        F.count("*").alias("n_geometries"), F.min(geom_id).alias("first_geometry")
    )
    return events.join(counted, pk, "left").withColumn("n_geometries", F.coalesce("n_geometries", F.lit(0)))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, and its percent of all rows."""
    n = df.groupBy(column).agg(F.count("*").alias("n"))
    every = n.agg(F.sum("n").alias("_every"))  # one row
    return n.crossJoin(F.broadcast(every)).select(column, "n", (F.col("n") * 100.0 / F.col("_every")).alias("pct"))


def distinct_counts(df: DataFrame, columns: list[str], lists: list[str] = ()) -> DataFrame:
    """``column, n_distinct``: different values of each column, and different entries of each list; null doesn't count.

    Rows are taken apart into (column, value as text) and made distinct by two
    shuffled aggregates, so no task holds the values of a whole column. Columns
    must be of types whose texts tell their values apart.
    """

    def cells(c: str, entries: Column) -> Column:
        return F.transform(entries, lambda x: F.struct(F.lit(c).alias("column"), x.cast("string").alias("value")))

    every = [cells(c, F.array(c)) for c in columns] + [F.coalesce(cells(c, F.col(c)), F.array()) for c in lists]
    names = df.sparkSession.createDataFrame([(c,) for c in (*columns, *lists)], "column string")
    found = df.select(F.explode(F.concat(*every)).alias("_x")).select("_x.*").where("value IS NOT NULL").distinct()
    counted = found.groupBy("column").agg(F.count("*").alias("n_distinct"))
    return names.join(F.broadcast(counted), "column", "left").select("column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))
