"""The prefix trie of conversations, by rolling fingerprints of their turns.

Each turn is known by the SHA-256 of its role and text, so texts are read once
and never shuffled. A prefix's fingerprint is a polynomial over its turns,
modulo two primes, made by numpy scans over rows sorted by range; the scans of
a conversation's pieces are added up, so a conversation of any length is spread
over tasks like other rows. Equal fingerprints of one depth are candidates: all
members must agree with their group's representative, the least id, in the turn
and in the group of the prefix before it, which by induction over depths is
agreement turn by turn. Groups that don't are split and grouped again.

Sums over subtrees need no recursion. The nodes whose least member is c are a
chain down c's path, and c is a member of every node above the chain's head. So
a node's subtree is its own chain from there on, and the whole chains of its
other members: a sum over members, less its chain's nodes above it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import numbered, table

#: Moduli and bases of the two fingerprints; products stay below 2^62.
PRIMES = (2147483647, 2147483629)
BASES = (1182737443, 947193211)
#: A null id is ordered after all others.
NO_ID = 2**63 - 1
#: Depths of a chain that are added up at once, and ids that are joined at once.
RUN = 4096
IDS = 2000

NODE = ["depth", "print", "split"]
KEYS = ["k0", "k1", "k2", "k3"]


def turn_keys(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``_c, _turn, _role, _key, _bytes`` of each row; null roles and texts are empty.

    ``_key`` is the SHA-256 of the role's length, the role and the text.
    """
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    return rows.select(
        F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("_c"),
        F.col(f"`{turn_col}`").cast("long").alias("_turn"),
        role.alias("_role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("_key"),
        F.octet_length(text).cast("long").alias("_bytes"),
    )


def in_order(keys: DataFrame) -> DataFrame:
    """``_c, _at, _key, _bytes``: turns with their place from 0, by turn (null first), role and key."""
    return numbered(keys, ["_c"], ["_turn", "_role", "_key"], "_at").select("_c", "_at", "_key", "_bytes")


def real_id(column: str) -> Column:
    return F.when(F.col(column) != NO_ID, F.col(column))


def _power(base: int, exponents, prime: int):
    """``base`` to each exponent, modulo ``prime``, by squaring."""
    import numpy as np

    out = np.ones(len(exponents), np.int64)
    left, square = exponents.copy(), base % prime
    while left.any():
        out[left & 1 == 1] = out[left & 1 == 1] * square % prime
        square, left = square * square % prime, left >> 1
    return out


_SCANNED = (
    "_c long, depth long, k0 long, k1 long, k2 long, k3 long, _bytes long, p0 long, p1 long, t0 long, t1 long"
)


def _scan(primes: tuple[int, int], bases: tuple[int, int]):
    """Running sums of each conversation's terms, within a task's sorted rows."""

    def scan(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        last, carried = None, [0, 0]
        for batch in batches:
            if not batch.num_rows:
                continue
            c, depth = (batch.column(k).to_numpy() for k in ("_c", "depth"))
            keys = np.frombuffer(b"".join(batch.column("_key").to_pylist()), ">i8").astype(np.int64).reshape(-1, 4)
            starts = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1])
            lengths = np.diff(np.append(starts, len(c)))
            sums, terms = [], []
            for k in range(2):
                value = (keys[:, 0].view(np.uint64) % np.uint64(primes[k])).astype(np.int64)
                term = value * _power(bases[k], depth, primes[k]) % primes[k]
                total = np.cumsum(term)
                total -= np.repeat(total[starts] - term[starts], lengths)
                if c[0] == last:
                    total[: lengths[0]] += carried[k]
                total %= primes[k]
                carried[k] = int(total[-1])
                sums.append(total)
                terms.append(term)
            last = c[-1]
            columns = [c, depth, *keys.T, batch.column("_bytes").to_numpy(), *sums, *terms]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(x)) for x in columns], [f.split()[0] for f in _SCANNED.split(", ")]
            )

    return scan


def prefixes(turns: DataFrame, primes: tuple[int, int] = PRIMES, bases: tuple[int, int] = BASES) -> DataFrame:
    """Each turn with its prefix's fingerprint ``print`` and that of the one before, ``above``.

    ``turns``: ``_c, depth`` (from 1, gapless), ``_key, _bytes``. Each task scans
    its rows; a conversation that began in tasks before takes their sums along.
    Those are at most one row a partition, and only they are broadcast.
    """
    keys = [F.col("_c"), F.col("depth")]
    scanned = (
        turns.select("_c", F.col("depth").cast("long"), "_key", "_bytes")
        .repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .mapInArrow(_scan(primes, bases), _SCANNED)
        .withColumn("_part", F.spark_partition_id())
    )
    rows = table(scanned, "scanned")
    ends = rows.groupBy("_part").agg(F.max(F.struct("_c", "depth", "p0", "p1")).alias("e")).select("_part", "e.*")
    earlier = Window.partitionBy("_c").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    carried = ends.select(
        "_c",
        F.lead("_part").over(Window.orderBy("_part")).alias("_next"),  # a row a partition
        *[F.sum(f"p{k}").over(earlier).alias(f"_carry{k}") for k in range(2)],
    ).select("_c", F.col("_next").alias("_part"), "_carry0", "_carry1")
    rows = rows.join(F.broadcast(carried), ["_c", "_part"], "left")

    def whole(k: int, less: Column | None = None) -> Column:
        found = F.col(f"p{k}") + F.coalesce(f"_carry{k}", F.lit(0))
        return F.pmod(found if less is None else found - less, F.lit(primes[k]))

    return rows.select(
        "_c",
        "depth",
        *KEYS,
        "_bytes",
        (whole(0) * 2**31 + whole(1)).alias("print"),
        (whole(0, F.col("t0")) * 2**31 + whole(1, F.col("t1"))).alias("above"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row a candidate group; ``same`` where all members agree with the representative."""
    held = [*KEYS, "above", "above_split"]
    same = F.lit(True)
    for c in held:
        same = same & (F.min(c) == F.max(c))
    return rows.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"),
        F.min("_c").alias("_rep"),
        F.min("_bytes").alias("_bytes"),
        F.min("above").alias("above"),
        F.min("above_split").alias("above_split"),
        same.alias("same"),
    )


def _split(rows: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """Rows whose conversation first left its representative at some depth get another ``split`` from there on."""
    held = [*KEYS, "above", "above_split"]
    bad = groups.where("not same").select(*NODE, "_rep")
    inside = table(rows.join(bad, NODE), "collided")
    reps = inside.where("_c = _rep").select(*NODE, *[F.col(c).alias(f"_rep_{c}") for c in held])
    differs = F.lit(False)
    for c in held:
        differs = differs | (F.col(c) != F.col(f"_rep_{c}"))
    mark = F.xxhash64(F.lit(turn), "depth", "print", "split", *held)
    first = (
        inside.join(reps, NODE)
        .where(differs)
        .groupBy("_c")
        .agg(F.min("depth").alias("_from"), F.min_by(mark, "depth").alias("_mark"))
    )
    rows = rows.join(first, "_c", "left")
    moved, moved_above = F.col("depth") >= F.col("_from"), F.col("depth") > F.col("_from")
    return rows.withColumns(
        {
            "split": F.when(moved, F.xxhash64("split", "_mark")).otherwise(F.col("split")),
            "above_split": F.when(moved_above, F.xxhash64("above_split", "_mark")).otherwise(F.col("above_split")),
        }
    ).drop("_from", "_mark")


def _hash_ids(batches: Iterator) -> Iterator:
    """The digest of each node's joined ids from its pieces, in order; one piece at a time."""
    import hashlib

    import pyarrow as pa

    schema = pa.schema([("depth", pa.int64()), ("print", pa.int64()), ("split", pa.int64()), ("ends_sha256", pa.string())])
    node, digest = None, None
    for batch in batches:
        done = []
        for depth, print_, split, ids in zip(*(batch.column(c) for c in (*NODE, "ids")), strict=True):
            now = (depth.as_py(), print_.as_py(), split.as_py())
            if now == node:
                digest.update(b",")
            else:
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = now, hashlib.sha256()
            digest.update(ids.as_py().encode())
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.types[k]) for k in range(4)], schema=schema)
    if node is not None:
        done = [(*node, digest.hexdigest())]
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], schema.types[k]) for k in range(4)], schema=schema)


def _ends(rows: DataFrame) -> DataFrame:
    """``ends_sha256`` of each node at which a conversation ends.

    Ids are joined in pieces of bounded size, in order. A SHA-256 can't be put
    together from parts, so one task goes over a node's pieces, holding one.
    """
    last = rows.groupBy("_c").agg(F.max_by(F.struct(*NODE), "depth").alias("n"))
    at = numbered(last.select("n.*", "_c"), NODE, ["_c"], "_i")
    said = F.transform(
        F.array_sort(F.collect_list("_c")), lambda c: F.when(c == NO_ID, F.lit("")).otherwise(c.cast("string"))
    )
    pieces = at.groupBy(*NODE, F.floor(F.col("_i") / IDS).alias("piece")).agg(F.array_join(said, ",").alias("ids"))
    return (
        pieces.repartition(*NODE)
        .sortWithinPartitions(*NODE, "piece")
        .mapInArrow(_hash_ids, "depth long, print long, split long, ends_sha256 string")
    )


def _above_on_chain(nodes: DataFrame) -> DataFrame:
    """``_rep, depth, _over``: what the chain's nodes above this one save, in two steps of bounded windows."""
    run = F.floor(F.col("depth") / RUN).alias("_run")
    weighed = nodes.select("_rep", "depth", "_saves", run)
    earlier = Window.partitionBy("_rep").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (
        weighed.groupBy("_rep", "_run")
        .agg(F.sum("_saves").alias("s"))
        .select("_rep", "_run", F.sum("s").over(earlier).alias("_runs"))
    )
    inside = Window.partitionBy("_rep", "_run").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    return (
        weighed.select("_rep", "_run", "depth", F.sum("_saves").over(inside).alias("_here"))
        .join(runs, ["_rep", "_run"])
        .select("_rep", "depth", (F.coalesce("_here", F.lit(0)) + F.coalesce("_runs", F.lit(0))).alias("_over"))
    )


def build(
    turns: DataFrame,
    convs: DataFrame,
    primes: tuple[int, int] = PRIMES,
    bases: tuple[int, int] = BASES,
) -> DataFrame:
    """One row for each node of the trie: each distinct sequence of first turns, the root included.

    ``turns``: ``_c, depth`` (from 1, gapless), ``_key, _bytes``; ``convs``: the
    ``_c`` of all conversations, once each, those without turns, too. Returns
    ``conv_id`` (the least member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves``, ``saved_tokens`` (over the subtree, bytes of the
    last turn times members but one) and ``ends_sha256`` (of the ids that end
    there, ascending, joined by commas).

    Defined cases: repeated rows are turns of their own; equal conversations
    share all their nodes; a null id is one conversation, ordered last and
    joined as an empty text; without conversations there is no node.
    """
    root = convs.select(
        "_c",
        F.lit(0).cast("long").alias("depth"),
        *[F.lit(0).cast("long").alias(c) for c in (*KEYS, "_bytes", "print", "above")],
    )
    rows = prefixes(turns, primes, bases).unionByName(root)
    zero = F.lit(0).cast("long")
    rows = table(rows.withColumns({"split": zero, "above_split": zero}), "prefixes")
    groups = table(_groups(rows), "groups")
    turn = 0
    while not groups.where("not same").isEmpty():
        turn += 1
        rows = table(_split(rows, groups, turn), "prefixes")
        groups = table(_groups(rows), "groups")

    children = (
        groups.where("depth > 0")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("above").alias("print"), F.col("above_split").alias("split"))
        .agg(F.count("*").alias("n_children"))
    )
    parents = groups.select(
        (F.col("depth") + 1).alias("depth"),
        F.col("print").alias("above"),
        F.col("split").alias("above_split"),
        F.col("_rep").alias("_parent"),
    )
    nodes = table(
        groups.join(children, NODE, "left")
        .join(parents, ["depth", "above", "above_split"], "left")
        .select(
            *NODE,
            "_rep",
            "_parent",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            ((F.col("n_convs") - 1) * F.col("_bytes")).alias("_saves"),
        ),
        "nodes",
    )
    chains = nodes.groupBy("_rep").agg(
        F.sum("_saves").alias("_chain"), F.max((F.col("n_children") == 0).cast("long")).alias("_leaf")
    )
    below = (
        rows.select("_c", *NODE)
        .join(chains.where("_chain <> 0 or _leaf <> 0").withColumnRenamed("_rep", "_c"), "_c")
        .groupBy(*NODE)
        .agg(F.sum("_chain").alias("_all"), F.sum("_leaf").alias("n_leaves"))
    )
    return (
        nodes.join(below, NODE)
        .join(_ends(rows), NODE, "left")
        .join(_above_on_chain(nodes), ["_rep", "depth"])
        .select(
            real_id("_rep").alias("conv_id"),
            "depth",
            real_id("_parent").alias("parent_conv_id"),
            "n_convs",
            "n_children",
            "n_leaves",
            (F.col("_all") - F.col("_over")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
        )
    )


def prefix_trie(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The trie of a table of turns as it stands; see ``build``."""
    turns = in_order(turn_keys(rows, id_col, turn_col, role_col, text_col))
    turns = turns.select("_c", (F.col("_at") + 1).alias("depth"), "_key", "_bytes")
    return build(turns, turns.select("_c").distinct())
