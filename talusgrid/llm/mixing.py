"""Temperature mixing of sources, as DataFrame operations only.

Token shares of sources are raised to an exponent and normalised. The exponent
is found by bisection: the entropy of the weights falls as it grows, and so
does the repetition that the rarest source needs. The weights are realised as
budgeted block permutations: each source is dealt into blocks of bounded size
by a hash, each block is put in a fresh pseudo-random order for every pass,
whole passes are taken while the budget lasts and a last pass as far as it
goes. A block needs no other block, so a source that holds a third of all rows
is spread over as many tasks as it has blocks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import SPACE

#: Tokens of a block, about.
BLOCK_TOKENS = 200_000
#: Rows of a block, about: rows without words, and rows repeated with one id and text, are split by it.
BLOCK_ROWS = 100_000
#: No source is repeated more often.
REPETITION_LIMIT = 2.0
#: Sources, and keys of very many rows, up to which they are broadcast; beyond, they are joined.
BROADCAST_SOURCES = 10_000
#: Halvings of the exponent's range [0, 1].
HALVINGS = 40


def token_count(text: Column) -> Column:
    """Words of a text; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.size(F.filter(F.split(text, SPACE), lambda w: w != "")).cast("long")


def find_exponent(
    shares: DataFrame,
    entropy: float | None = None,
    repetition: float | None = None,
    halvings: int = HALVINGS,
) -> float:
    """The exponent in [0, 1] that meets a limit on the sources' weights.

    ``shares`` has a row ``p`` for each source. With ``entropy``: the exponent
    at which the weights' entropy, as a fraction of the greatest possible, is
    that; entropy falls as the exponent grows. With ``repetition``: the least
    exponent at which the rarest source is repeated no more often than that
    when the most common is used once, which is (p_max / p_min)^(1 - exponent).
    With both, the greater of the two. With no source or one, 1.

    Each step is one aggregate over the sources; two numbers reach the driver.
    """
    lowest = shares.agg(F.min("p").alias("lo"), F.max("p").alias("hi"), F.count("*").alias("n")).first()
    if lowest["n"] < 2 or lowest["lo"] == lowest["hi"]:
        return 1.0

    def fits(a: float) -> bool:
        if repetition is not None and (lowest["hi"] / lowest["lo"]) ** (1 - a) > repetition:
            return False
        if entropy is None:
            return True
        w = F.pow("p", F.lit(a))
        row = shares.agg(F.sum(w).alias("z"), F.sum(w * F.lit(a) * F.log("p")).alias("s")).first()
        return (math.log(row["z"]) - row["s"] / row["z"]) / math.log(lowest["n"]) <= entropy

    low, high = 0.0, 1.0
    if fits(low):
        return low
    for _ in range(halvings):
        middle = (low + high) / 2
        if fits(middle):
            high = middle
        else:
            low = middle
    return high


def source_sums(df: DataFrame, source_col: str, tokens: Column) -> DataFrame:
    """``_source, _tokens, _rows`` of every source, kept in the shared folder."""
    rows = df.select(F.col(source_col).alias("_source"), tokens.alias("_n"))
    return rows.groupBy("_source").agg(F.sum("_n").alias("_tokens"), F.count("*").alias("_rows")).checkpoint()


def weights(
    df: DataFrame,
    source_col: str = "source",
    tokens: Column | None = None,
    text_col: str = "text",
    entropy: float | None = None,
    repetition: float | None = REPETITION_LIMIT,
    budget: int | None = None,
    halvings: int = HALVINGS,
    sums: DataFrame | None = None,
) -> DataFrame:
    """``_source, _tokens, _weight, _times`` for each source that has tokens.

    ``_times`` is how often the budget lets a source be used. Without a budget
    it is the least at which every source is used whole once. ``sums`` are
    ``source_sums`` where they are made already.
    """
    tokens = token_count(F.col(text_col)) if tokens is None else tokens
    sums = source_sums(df, source_col, tokens) if sums is None else sums
    sums = sums.where("_tokens > 0").drop("_rows")
    total = sums.agg(F.sum("_tokens").alias("t")).first()["t"] or 0
    shares = sums.select("*", (F.col("_tokens") / F.lit(max(total, 1))).alias("p"))
    a = find_exponent(shares, entropy, repetition, halvings)
    raw = shares.withColumn("_raw", F.pow("p", F.lit(a)))
    row = raw.agg(F.sum("_raw").alias("z"), F.max(F.col("p") / F.col("_raw")).alias("k")).first()
    z, k = row["z"] or 1.0, row["k"] or 1.0
    spend = budget if budget is not None else total * k * z
    return raw.select(
        "_source",
        "_tokens",
        (F.col("_raw") / F.lit(z)).alias("_weight"),
        (F.lit(float(spend)) * F.col("_raw") / F.lit(z) / F.col("_tokens")).alias("_times"),
    )


def _key(id_col: Column, text: Column) -> Column:
    return F.concat_ws(":", id_col.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _crowded(df: DataFrame, id_col: str, text_col: str, block_rows: int) -> DataFrame | None:
    """``_key, _hot`` of ids and texts with more rows than a block has; None where there are none.

    There are at most as many as the table has blocks. They are found by an
    aggregate that is put together where rows are read, and written.
    """
    from .common import table

    counted = df.groupBy(_key(F.col(id_col), F.col(text_col)).alias("_key")).count()
    hot = table(counted.where(F.col("count") > block_rows).select("_key", F.lit(True).alias("_hot")), "crowded-keys")
    n = hot.count()
    if not n:
        return None
    return F.broadcast(hot) if n <= BROADCAST_SOURCES else hot


def mix(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    entropy: float | None = None,
    repetition: float | None = REPETITION_LIMIT,
    budget: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = 7,
    halvings: int = HALVINGS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``df``'s rows as often as their source's weight asks, with ``mix_`` columns.

    ``mix_pass`` (0 for the first), ``mix_block`` and ``mix_rank`` (from 1, the
    place in the block's order of that pass) put the rows in order; ``mix_tokens``
    is the text's words. Within a block, a pass that the budget covers only in
    part takes rows in order while the middle of the row's tokens lies within
    what is left, so a block's error is half a row at most and has no sign.

    Defined cases: a null source is a source of its own; rows without tokens
    (null and empty texts) cost nothing and come once; a source of such rows
    alone does too; repeated rows and null ids are rows like others, ordered by
    id, then text. A source has a block for each ``block_rows`` of its rows at
    least, so rows without tokens are split, too, and rows of one id and text
    are dealt over all its blocks when there are more of them than that. Columns of ``df`` named ``mix_...`` are replaced; an empty
    table gives no rows.
    """
    from .common import shared_dir

    shared_dir(df.sparkSession)
    columns = [c for c in df.columns if c not in ("mix_pass", "mix_block", "mix_rank", "mix_tokens")]
    sums = source_sums(df, source_col, token_count(F.col(text_col)))
    plan = weights(df, source_col, None, text_col, entropy, repetition, budget, halvings, sums)
    blocks = F.greatest(F.ceil(F.col("_tokens") / F.lit(block_tokens)), F.ceil(F.col("_rows") / F.lit(block_rows)))
    every = sums.select(F.col("_source").alias("_known"), blocks.cast("long").alias("_blocks"))
    plan = every.join(plan, F.col("_known").eqNullSafe(F.col("_source")), "left").select(
        F.col("_known").alias("_source"), "_times", "_blocks"
    )
    if sums.count() <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    picked = F.col("_row").getField
    rows = df.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), token_count(F.col(text_col)).alias("_n")
    )
    rows = rows.join(plan, picked(source_col).eqNullSafe(F.col("_source")), "left")
    key = _key(picked(id_col), picked(text_col))
    rows = rows.withColumn("_key", key)
    hot = _crowded(df, id_col, text_col, block_rows)
    if hot is None:
        dealt = F.lit(0)
    else:
        rows = rows.join(hot, "_key", "left")
        dealt = F.when(F.col("_hot"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "_key"))
    rows = rows.select(
        "_row",
        "_n",
        "_key",
        F.coalesce("_times", F.lit(1.0)).alias("_times"),
        F.pmod(F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long") + dealt, F.greatest("_blocks", F.lit(1))).alias("mix_block"),
    )
    free = F.col("_n") == 0
    passes = F.when(free, F.lit(1)).otherwise(F.greatest(F.ceil("_times").cast("int"), F.lit(1)))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), passes - 1)).alias("mix_pass"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("mix_pass").cast("string"), "_key"))
    block = Window.partitionBy(picked(source_col), "mix_block", "mix_pass")
    ordered = block.orderBy(order, "_key")
    rows = rows.select(
        "*",
        F.row_number().over(ordered).cast("long").alias("mix_rank"),
        F.sum("_n").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"),
        F.sum("_n").over(block).alias("_all"),
    )
    share = F.least(F.col("_times") - F.col("mix_pass"), F.lit(1.0))
    taken = (share >= 1.0) | free | (F.col("_upto") - F.col("_n") / 2 <= share * F.col("_all"))
    return rows.where(taken).select(
        *[picked(c).alias(c) for c in columns],
        F.col("mix_pass"),
        F.col("mix_block"),
        F.col("mix_rank"),
        F.col("_n").alias("mix_tokens"),
    )
