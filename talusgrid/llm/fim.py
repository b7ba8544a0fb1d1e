"""Fill-in-middle: texts cut at two ranks of their units and put in another order.

A text's units are the matches of a pattern, left to right. They are walked
over twice: the first pass only counts them, the second advances a lazy match
iterator to the lower and then to the upper rank and stops there. No list of
units is ever stored, so a text needs no memory beside itself, however long.
The ranks and forms are drawn from a hash of the id, so a task that is run
again gives the same rows. The rest is DataFrame expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Leading white space belongs to the word after it; at the end it is a unit.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are cut, and of those the per cent that start with the suffix.
CUT_PER_CENT = 50
SPM_PER_CENT = 80


def count_units(unit: re.Pattern, text: str) -> int:
    """First pass: how many units ``text`` has."""
    return sum(1 for _ in unit.finditer(text))


def ends_at(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the first ``low`` and the first ``high`` units end, in code points."""
    matches = unit.finditer(text)
    start = end = 0
    if low:
        start = end = next(islice(matches, low - 1, None)).end()
    if high > low:
        end = next(islice(matches, high - low - 1, None)).end()
    return start, end


def _cuts(pattern: str):
    @F.arrow_udf("struct<n:long,start:long,stop:long>")
    def cuts(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        unit = re.compile(pattern)
        for texts, first, second in parts:
            found = []
            for text, a, b in zip(texts, first, second, strict=True):
                text = text.as_py()  # one text at a time as a Python string
                n = count_units(unit, text)
                low, high = sorted((a.as_py() % (n + 1), b.as_py() % (n + 1)))
                found.append((n, *ends_at(unit, text, low, high)))
            yield pa.StructArray.from_arrays(
                [pa.array([f[k] for f in found], pa.int64()) for k in range(3)], ["n", "start", "stop"]
            )

    return cuts


def check_markers(markers: tuple[str, ...]) -> None:
    """Raise unless joined texts without markers can be told apart again.

    No marker may lie in another, nor may one's end be another's beginning:
    then a text's end and a marker can't make a marker that nobody wrote.
    """
    if len(set(markers)) < len(markers) or not all(markers):
        raise ValueError("markers must differ and not be empty")
    for a in markers:
        for b in markers:
            if (a != b and a in b) or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))):
                raise ValueError(f"markers {a!r} and {b!r} overlap")


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    seed: int = 42,
    cut_per_cent: int = CUT_PER_CENT,
    spm_per_cent: int = SPM_PER_CENT,
    markers: tuple[str, str, str] = MARKERS,
    unit: str = UNIT,
) -> DataFrame:
    """``docs`` with ``fim_n`` units, ``fim_form``, ``fim_start``, ``fim_stop`` and ``fim_text``.

    The middle is the code points from ``fim_start`` to before ``fim_stop``;
    both are null where the form is ``plain``. ``psm`` texts are prefix, suffix
    and middle, each after its marker; ``spm`` ones begin with the suffix.

    Defined cases: a null text is an empty one, and an empty text is plain; so
    is a text that holds a marker, as it could not be restored; a null id draws
    like an empty one; rows repeated with one id share their draws, each is cut
    by its own text; columns of ``docs`` named ``fim_...`` are replaced; an
    empty table gives no rows. No row is moved: there is no shuffle.
    """
    check_markers(markers)
    small_batches(docs.sparkSession)
    kept = [F.col(f"`{c}`") for c in docs.columns if not c.startswith("fim_")]
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(*kept, text.alias("fim_text"), drawn.alias("fim_draw"))

    def draw(k: int) -> Column:
        return F.conv(F.substring("fim_draw", 8 * k + 1, 8), 16, 10).cast("long")

    rows = rows.withColumn("fim_cut", _cuts(unit)("fim_text", draw(0), draw(1)))
    n, start, stop = (F.col(f"fim_cut.{c}") for c in ("n", "start", "stop"))
    whole = F.col("fim_text")
    plain = (whole == "") | (draw(2) % 100 >= cut_per_cent)
    for marker in markers:
        plain = plain | F.contains(whole, F.lit(marker))
    form = F.when(plain, "plain").when(draw(3) % 100 < spm_per_cent, "spm").otherwise("psm")
    rows = rows.withColumn("fim_form", form)
    prefix = F.concat(F.lit(markers[0]), F.substring(whole, F.lit(1), start.cast("int")))
    middle = F.concat(F.lit(markers[2]), F.substring(whole, (start + 1).cast("int"), (stop - start).cast("int")))
    suffix = F.concat(F.lit(markers[1]), F.substring(whole, (stop + 1).cast("int"), F.length(whole)))
    is_plain = F.col("fim_form") == "plain"
    out = (
        F.when(is_plain, whole)
        .when(F.col("fim_form") == "psm", F.concat(prefix, suffix, middle))
        .otherwise(F.concat(suffix, prefix, middle))
    )
    return rows.select(
        *kept,
        n.alias("fim_n"),
        "fim_form",
        F.when(~is_plain, start).alias("fim_start"),
        F.when(~is_plain, stop).alias("fim_stop"),
        out.alias("fim_text"),
    )


def restore(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that ``transform`` was given, from its output and form alone."""
    p, s, m = (F.lit(x) for x in markers)
    middle = F.split_part(output, m, F.lit(2))
    psm = F.split_part(output, m, F.lit(1))
    spm = F.split_part(psm, p, F.lit(2))
    return (
        F.when(form == "plain", output)
        .when(
            form == "psm",
            F.concat(F.split_part(F.split_part(psm, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(psm, s, F.lit(2))),
        )
        .otherwise(F.concat(spm, middle, F.split_part(F.split_part(psm, p, F.lit(1)), s, F.lit(2))))
    )
