"""Language identification by a byte-level convolutional network.

Fixed-length windows of bytes go through filters of several widths, the
greatest response of each filter in a window feeds a softmax. Training is
numpy on the driver over a bounded sample of labelled rows; prediction covers
every byte of every text, window after window, and averages the windows'
probabilities by their lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches
from .substrings import texts_of

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
#: The training sample's bounds: rows of a language, windows of a row.
ROWS_PER_LANGUAGE = 400
WINDOWS_PER_ROW = 4
UNKNOWN = "und"


class Network:
    """Embedded bytes, convolutions of several widths, max pooling, softmax."""

    def __init__(self, classes: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.p = {"e": rng.normal(0, 0.5, (257, EMBED)).astype(np.float32)}
        for w in WIDTHS:
            self.p[f"k{w}"] = rng.normal(0, (w * EMBED) ** -0.5, (w * EMBED, FILTERS)).astype(np.float32)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["o"] = rng.normal(0, 0.1, (FILTERS * len(WIDTHS), classes)).astype(np.float32)
        self.p["c"] = np.zeros(classes, np.float32)

    def grads(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy of windows ``x`` (n, WINDOW) and classes ``y``."""
        p, n = self.p, len(x)
        emb = p["e"][x]
        pooled, kept = [], []
        for w in WIDTHS:
            steps = WINDOW - w + 1
            cols = np.concatenate([emb[:, k : k + steps] for k in range(w)], axis=2)
            out = cols @ p[f"k{w}"]
            top = out.argmax(axis=1)
            best = np.take_along_axis(out, top[:, None, :], axis=1)[:, 0] + p[f"b{w}"]
            pooled.append(np.maximum(best, 0))
            kept.append((cols, top, best > 0))
        h = np.concatenate(pooled, axis=1)
        z = h @ p["o"] + p["c"]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        z[np.arange(n), y] -= 1
        z /= n
        g = {"o": h.T @ z, "c": z.sum(axis=0), "e": np.zeros_like(p["e"])}
        back = z @ p["o"].T
        rows = np.arange(n)[:, None]
        for at, w in enumerate(WIDTHS):
            cols, top, alive = kept[at]
            d = back[:, at * FILTERS : (at + 1) * FILTERS] * alive
            g[f"b{w}"] = d.sum(axis=0)
            seen = cols[rows, top]  # (n, filters, w * embed)
            g[f"k{w}"] = np.einsum("nf,nfc->cf", d, seen)
            into = (d[:, :, None] * p[f"k{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            places = top[:, :, None] + np.arange(w)
            np.add.at(g["e"], x[rows[:, :, None], places], into)
        return g

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 600, batch: int = 64, rate: float = 0.01, seed: int = 5):
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        for t in range(1, steps + 1):
            at = rng.integers(0, len(x), batch)
            for k, g in self.grads(x[at], y[at]).items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                now = rate * min(1.0, 2 * (1 - t / steps) + 0.05)
                self.p[k] -= (now * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self

    def tables(self) -> dict[str, np.ndarray]:
        """What each byte adds to each filter at each place of it."""
        out = {"o": self.p["o"], "c": self.p["c"]}
        for w in WIDTHS:
            k = self.p[f"k{w}"].reshape(w, EMBED, FILTERS)
            out[f"t{w}"] = np.stack([self.p["e"] @ k[i] for i in range(w)])
            out[f"b{w}"] = self.p[f"b{w}"]
        return out


def predict(tables: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Class probabilities of windows (n, WINDOW) of byte values."""
    pooled = []
    for w in WIDTHS:
        steps = WINDOW - w + 1
        out = tables[f"t{w}"][0][x[:, :steps]]
        for k in range(1, w):
            out += tables[f"t{w}"][k][x[:, k : k + steps]]
        pooled.append(np.maximum(out.max(axis=1) + tables[f"b{w}"], 0))
    z = np.concatenate(pooled, axis=1) @ tables["o"] + tables["c"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def windows_of(text: bytes) -> np.ndarray:
    """The whole text as windows of bytes; 256 fills the last."""
    n = -(-len(text) // WINDOW)
    out = np.full(n * WINDOW, 256, dtype=np.int16)
    out[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def _label(tables: dict[str, np.ndarray], classes: list[str], fields: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, bounds = texts_of(batch.column(0))
            letters = batch.column(1).to_numpy(zero_copy_only=False)
            sizes = np.diff(bounds)
            counts = -(-sizes // WINDOW)
            first = np.concatenate([[0], np.cumsum(counts)])
            owner = np.repeat(np.arange(len(sizes)), counts)
            start = bounds[owner] + (np.arange(first[-1]) - first[owner]) * WINDOW
            total = np.zeros((len(sizes), len(classes)))
            for at in range(0, len(start), 256):
                part = slice(at, at + 256)
                places = start[part, None] + np.arange(WINDOW)
                inside = places < bounds[owner[part] + 1][:, None]
                x = np.where(inside, buf[np.minimum(places, len(buf) - 1)].astype(np.int16), np.int16(256))
                np.add.at(total, owner[part], predict(tables, x) * inside.sum(axis=1)[:, None])
            share = total / np.maximum(total.sum(axis=1, keepdims=True), 1e-30)
            best = share.argmax(axis=1)
            known = letters.astype(bool) & (sizes > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[2:],
                    pa.array([classes[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]),
                    pa.array(np.where(known, np.minimum(share.max(axis=1), 1.0), 0.0)),
                ],
                names=fields,
            )

    return run


def fit(
    df: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    rows: int = ROWS_PER_LANGUAGE,
    windows: int = WINDOWS_PER_ROW,
    steps: int = 600,
) -> tuple[Network | None, list[str]]:
    """A network for the languages of the labelled rows of ``df``.

    Every label is a class. Learns from at most ``rows`` different texts of
    each, chosen by a hash of the text, and from ``windows`` windows of each;
    copies of a text count once, so none of them crowds others out. Without a
    labelled row there is no network.
    """
    usable = df.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(
        F.col(lang_col).cast("string").alias("_lang"), F.col(text_col).alias("_text")
    )
    counts = {
        r["_lang"]: r["texts"]
        for r in usable.groupBy("_lang")
        .agg(F.approx_count_distinct("_text").alias("texts"))
        .collect()
    }
    classes = sorted(counts)
    if not classes:
        return None, []
    pairs = [F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * rows / max(n, 1)))]
    share = F.create_map(*pairs)[F.col("_lang")]
    dealt = F.pmod(F.xxhash64(F.col("_text"), F.lit(3)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    span = WINDOW * windows
    # a stretch of the text that starts at a place given by its hash
    begin = F.pmod(F.xxhash64("_text"), F.greatest(F.length("_text") - span, F.lit(0)) + 1) + 1
    # copies collapse before they are shuffled
    drawn = (
        usable.where(dealt < share)
        .select("_lang", F.xxhash64("_text", F.lit(5)).alias("_h"), F.substring("_text", begin.cast("int"), F.lit(span)).alias("_text"))
        .groupBy("_lang", "_h")
        .agg(F.min("_text").alias("_text"))
    )
    rank = F.row_number().over(Window.partitionBy("_lang").orderBy("_h"))
    sample = drawn.withColumn("_rank", rank).where(F.col("_rank") <= rows).orderBy("_lang", "_rank").collect()
    xs, ys = [], []
    for r in sample:
        x = windows_of(r["_text"].encode())[:windows]
        xs.append(x)
        ys += [classes.index(r["_lang"])] * len(x)
    if not xs:
        return None, []
    x, y = np.concatenate(xs), np.array(ys)
    # every language weighs the same
    rng = np.random.default_rng(2)
    even = np.concatenate([rng.choice(np.flatnonzero(y == c), 4 * len(y) // len(classes)) for c in np.unique(y)])
    return Network(len(classes)).train(x[even], y[even], steps=steps), classes


def identify(
    df: DataFrame,
    network: Network | None,
    classes: list[str],
    text_col: str = "text",
) -> DataFrame:
    """``df`` with ``lang_pred`` and ``lang_score``.

    Defined cases: null texts, texts without a letter, and all texts if there
    is no network, are ``und`` with score 0; repeated rows are each predicted;
    columns of ``df`` with those two names are replaced; an empty table gives
    no rows.
    """
    df = df.drop("lang_pred", "lang_score")
    if network is None:
        return df.select("*", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("lang_score"))
    small_batches(df.sparkSession)
    fields = [*df.columns, "lang_pred", "lang_score"]
    schema = df.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    text = F.col(text_col)
    return df.select(
        F.coalesce(text, F.lit("")).cast("binary").alias("_bytes"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
        "*",
    ).mapInArrow(_label(network.tables(), classes, fields), schema)
