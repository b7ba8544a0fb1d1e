"""Bounded-space online packing of token ids into sequences of fixed length.

Each input partition keeps a fixed number of open windows. A document's last
piece goes to the window it fits best; when it fits none and all windows are
open, the fullest is topped up with the head of the piece and emitted. What
partitions leave open is merged afterwards in groups of partitions, so no
task ever holds more than a fixed number of windows of each partition of its
group. Documents are never shuffled: a partition is packed where it is read.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, table

LENGTH = 2048
#: The id that ends each document.
END_ID = 1
#: Open windows of a partition.
OPEN = 64
#: Gaps of fewer ids than this are padded, not topped up.
LEAST_CUT = 8
#: Partitions whose leftovers are merged together.
GROUP = 16
#: Windows are numbered within a partition below this.
SPAN = 1 << 40

_SCHEMA = "_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, _part long"
_ARROW = pa.schema(
    [
        ("_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids", pa.binary()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("_part", pa.int64()),
    ]
)


class WordIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Where the vocabulary splits as ``_RULES`` say, it drops white space, so a
    text's ids are those of its words one after another, and each distinct word
    is tokenised once per worker. Texts with a special token's string, and all
    texts of a vocabulary with other rules, go to the tokenizer whole.
    """

    #: The normaliser and the splitting that the word by word way stands for.
    _RULES = (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    )

    #: Words kept, and half as many parts; at the limit the memory starts anew.
    LIMIT = 1_000_000
    #: Words of printable ASCII and Latin-1 letters: composed already, and each
    #: letter's lower case is one letter.
    _PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    _SPLIT = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
    #: The byte-level alphabet: printable bytes stand for themselves, the others
    #: for the characters from 256 on.
    _BYTES = {b: 256 + k for k, b in enumerate([*range(0x21), *range(0x7F, 0xA1), 0xAD])}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        rules = json.loads(self.tokenizer.to_str())
        self.by_word = (rules["normalizer"], rules["pre_tokenizer"]) == self._RULES and rules["model"]["type"] == "BPE"
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [
            np.asarray(e.ids, dtype="<u4").tobytes()
            for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def _part(self, part: str) -> bytes:
        ids = self.parts.get(part)
        if ids is None:
            spelt = part if part.isascii() else part.encode().decode("latin-1").translate(self._BYTES)
            found = [t.id for t in self.model.tokenize(spelt)]
            ids = self.parts[part] = struct.pack(f"<{len(found)}I", *found)
        return ids

    def _learn(self, new: list[bytes]) -> None:
        if len(self.words) + len(new) > self.LIMIT:
            self.words.clear()
        if 2 * len(self.parts) > self.LIMIT:
            self.parts.clear()
        other = []
        for word in new:
            text = word.decode()
            if self._PLAIN.fullmatch(text):
                self.words[word] = b"".join(map(self._part, self._SPLIT.findall(text.lower())))
            else:
                other.append(word)
        for at in range(0, len(other), 4096):
            chunk = other[at : at + 4096]
            self.words.update(zip(chunk, self._whole([w.decode() for w in chunk]), strict=True))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_word:
            return [self._whole([t.decode()])[0] for t in texts]
        whole = {k for k, t in enumerate(texts) if any(s in t for s in self.special)}
        split = [[] if k in whole else t.split() for k, t in enumerate(texts)]
        out = []
        for at in range(0, len(split), 200):
            chunk = split[at : at + 200]
            new = {w for words in chunk for w in words if w not in self.words}
            if new:
                if len(self.words) + len(new) > self.LIMIT:
                    new = {w for words in chunk for w in words}
                self._learn(list(new))
            known = self.words
            out += [b"".join([known[w] for w in words]) for words in chunk]
        for k in whole:
            out[k] = self._whole([texts[k].decode()])[0]
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One per worker process, kept between tasks."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


class Packer:
    """Best fit into at most ``most`` open windows of ``length`` ids."""

    def __init__(self, length: int, most: int, least_cut: int, first_id: int):
        self.length, self.most, self.least_cut = length, most, least_cut
        self.next_id = first_id
        self.gaps: list[tuple[int, int]] = []  # (gap, window), sorted
        self.open: dict[int, list[tuple]] = {}
        self.serial = 0
        self.done: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            n = len(ids) // 4
            self.done.append((doc, start, n, ids, total, self.next_id, at))
            at += n
        self.next_id += 1

    def _fit(self, gap_at: int, piece: tuple) -> None:
        gap, window = self.gaps.pop(gap_at)
        self.open[window].append(piece)
        gap -= len(piece[2]) // 4
        if gap:
            bisect.insort(self.gaps, (gap, window))
        else:
            self._emit(self.open.pop(window))

    def add(self, doc: int | None, start: int, ids: bytes, total: int) -> None:
        while len(ids) >= 4 * self.length:
            self._emit([(doc, start, ids[: 4 * self.length], total)])
            start, ids = start + self.length, ids[4 * self.length :]
        while ids:
            n = len(ids) // 4
            k = bisect.bisect_left(self.gaps, (n, -1))
            if k < len(self.gaps):
                self._fit(k, (doc, start, ids, total))
                return
            if len(self.open) < self.most:
                self.open[self.serial] = [(doc, start, ids, total)]
                bisect.insort(self.gaps, (self.length - n, self.serial))
                self.serial += 1
                return
            gap, window = self.gaps[0]
            if gap >= self.least_cut:
                self._fit(0, (doc, start, ids[: 4 * gap], total))
                start, ids = start + gap, ids[4 * gap :]
            else:
                self.gaps.pop(0)
                self._emit(self.open.pop(window))

    def close(self) -> None:
        """Fills the fullest windows with what the emptiest hold; emits all."""
        rest = sorted((self.length - gap, window) for gap, window in self.gaps)
        pieces = [p for _, window in reversed(rest) for p in self.open[window]]
        self.open, self.gaps = {}, []
        held: list[tuple] = []
        room = self.length
        for doc, start, ids, total in pieces:
            while ids:
                n = min(room, len(ids) // 4)
                held.append((doc, start, ids[: 4 * n], total))
                start, ids, room = start + n, ids[4 * n :], room - n
                if not room:
                    self._emit(held)
                    held, room = [], self.length
        if held:
            self._emit(held)


def _batch(rows: list[tuple], part: int) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=False)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array([part] * len(rows), pa.int64())], schema=_ARROW)


def _pack_partition(path: str, length: int, most: int, least_cut: int, end: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        packer = Packer(length, most, least_cut, part * SPAN)
        encoder = word_ids(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column(1).to_pylist()]
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                ids += end
                packer.add(doc, 0, ids, len(ids) // 4)
            if packer.done:
                yield _batch(packer.done, -1)
                packer.done = []
        # open windows travel on as they are, each under its own number
        for _, window in packer.gaps:
            packer._emit(packer.open[window])
        if packer.done:
            yield _batch(packer.done, part)

    return run


def _merge(length: int, most: int, least_cut: int, group: int):
    def run(left: pa.Table) -> pa.Table:
        rows = left.sort_by([("sequence_id", "ascending"), ("offset", "ascending")]).to_pylist()
        if not rows:
            return _ARROW.empty_table()
        at = min(r["_part"] for r in rows) // group
        packer = Packer(length, most, least_cut, (1 << 62) + at * SPAN)
        for r in sorted(rows, key=lambda r: -r["length"]):
            packer.add(r["_id"], r["start"], r["ids"], r["doc_tokens"])
        packer.close()
        return pa.Table.from_batches([_batch(packer.done, -1)])

    return run


def pack(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    open_windows: int = OPEN,
    least_cut: int = LEAST_CUT,
    group: int = GROUP,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces of packed sequences: one row each, with its ids.

    Columns: the id column, ``start`` (ids of the document before the piece),
    ``length``, ``ids`` (little-endian unsigned 32-bit), ``doc_tokens``,
    ``sequence_id`` and ``offset`` (where in the sequence it lies). A document
    is its ids and then ``end_id``.

    Defined cases: a null or empty text is the end id alone; a null id is kept
    as null; repeated rows are packed each on its own; a text longer than a
    window fills windows of its own and only its rest is placed; other columns
    are not carried, whatever their names; an empty table gives no rows.
    """
    spark = df.sparkSession
    small_batches(spark)
    source = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("binary").alias("_text"))
    end = np.array([end_id], dtype="<u4").tobytes()
    made = table(
        source.mapInArrow(_pack_partition(tokenizer_path, length, open_windows, least_cut, end), _SCHEMA),
        "packed",
    )
    left = made.where("_part >= 0")
    merged = left.groupBy(F.floor(F.col("_part") / group).alias("_group")).applyInArrow(
        _merge(length, open_windows, least_cut, group), _SCHEMA
    )
    out = made.where("_part < 0").unionByName(merged)
    return out.select(
        F.col("_id").alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset"
    )
