"""Chat formatting: layouts found by fingerprint, one template, loss spans.

A record's nested field paths are hashed; the hash selects a declarative
mapping that turns the record into canonical turns. Turns are formatted one
by one, so a conversation of any length is never held as one string: its
formatted text is its segments in order. Control strings inside texts are
escaped reversibly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches


@dataclass(frozen=True)
class Layout:
    """Where the turns of a record are.

    ``shape`` is the tree of its field names. Either ``turns`` names an array
    whose elements have ``role`` and ``text`` fields, or ``parts`` lists turns
    of a record without an array: a role and the fields that make its text, or
    a field for the role.
    """

    name: str
    shape: str
    schema: str
    turns: str | None = None
    role: str | None = None
    text: str | None = None
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    roles: dict[str, str] = field(default_factory=dict)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256(self.shape.encode()).hexdigest()


#: Other names of the three roles.
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
LAYOUTS = (
    Layout("turn", "{role,text}", "role string, text string", parts=(("$role", ("text",)),)),
    Layout(
        "messages", "{messages:[{content,role}]}", "messages array<struct<role:string,content:string>>",
        "messages", "role", "content",
    ),
    Layout(
        "conversations", "{conversations:[{from,value}]}", "conversations array<struct<`from`:string,value:string>>",
        "conversations", "from", "value", roles=ALIASES,
    ),
    Layout(
        "prompt", "{completion,prompt}", "prompt string, completion string",
        parts=(("user", ("prompt",)), ("assistant", ("completion",))),
    ),
    Layout(
        "instruction", "{input,instruction,output}", "instruction string, input string, output string",
        parts=(("user", ("instruction", "input")), ("assistant", ("output",))),
    ),
    Layout(
        "short instruction", "{instruction,output}", "instruction string, output string",
        parts=(("user", ("instruction",)), ("assistant", ("output",))),
    ),
)

#: Begins of control strings, of this template and of widespread others.
CONTROL = r"(<)(\||/?s>|</?SYS>>|start_of_turn>|end_of_turn>)|(\[)(/?INST\])"
END = "<|end|>\n"


def _bare(record: Column) -> Column:
    """A record with its escaped characters left out and its long values shortened."""
    bare = F.replace(F.replace(record, F.lit("\\\\")), F.lit('\\"'))
    return F.regexp_replace(bare, r'"[^"]{64,}"(?!\s*:)', '"_"')


def shape_of(record: Column) -> Column:
    """The tree of a JSON record's field names, in order of name; null if broken.

    Spark gives the record's schema; types of values are left out. Long values
    are shortened first, so that texts of any length leave the shape as it is.
    """
    schema = F.schema_of_variant(F.try_parse_json(_bare(record)))
    scalar = r": (?:STRING|BIGINT|DOUBLE|FLOAT|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\s*\d+\))(?=[,>])"
    names = F.regexp_replace(schema, scalar, "")
    for old, new in (("ARRAY<OBJECT<", ":[{"), ("OBJECT<", "{"), (">>(?=[,>]|$)", "}]"), (">", "}"), (": :", ":"), (", ", ",")):
        names = F.regexp_replace(names, old, new)
    return F.regexp_replace(names, "}}$", "}]}")


def fingerprint(record: Column) -> Column:
    return F.sha2(shape_of(record), 256)


def _holds(layout: Layout, record: Column) -> Column:
    """Whether a record has every field path of a layout, each a plain value, whatever else it has.

    An empty array has all paths of its elements; of other arrays, a path
    counts if any element has it.
    """
    got = F.from_json(_bare(record), layout.schema.replace(":string", ":variant").replace(" string", " variant"))

    def nested(value: Column) -> Column:
        return F.coalesce(F.schema_of_variant(value).rlike("^(OBJECT|ARRAY)"), F.lit(False))

    if layout.turns:
        turns, (role, text) = got[layout.turns], (layout.role, layout.text)
        either = F.exists(turns, lambda t: t[role].isNotNull()) & F.exists(turns, lambda t: t[text].isNotNull())
        plain = ~F.exists(turns, lambda t: nested(t[role]) | nested(t[text]))
        return F.coalesce((F.size(turns) == 0) | (either & plain), F.lit(False))
    names = [role[1:] for role, _ in layout.parts if role.startswith("$")] + [f for _, fields in layout.parts for f in fields]
    held = F.lit(True)
    for name in names:
        held = held & got[name].isNotNull() & ~nested(got[name])
    return F.coalesce(held, F.lit(False))


def _role(value: Column, roles: dict[str, str]) -> Column:
    out = F.coalesce(value, F.lit(""))
    for name, role in roles.items():
        out = F.when(value == name, F.lit(role)).otherwise(out)
    return out


def _turns(layout: Layout, record: Column) -> Column:
    got = F.from_json(record, layout.schema, {"maxStringLen": str(2**31 - 1)})
    if layout.turns:
        return F.transform(
            F.coalesce(got[layout.turns], F.array()),
            lambda t: F.struct(
                _role(t[layout.role], layout.roles).alias("role"),
                F.coalesce(t[layout.text], F.lit("")).alias("text"),
            ),
        )
    turns = []
    for role, fields in layout.parts:
        texts = [F.when(got[f] != "", got[f]) for f in fields]
        who = _role(got[role[1:]], layout.roles) if role.startswith("$") else F.lit(role)
        said = F.lit(True) if role.startswith("$") else F.coalesce(*[got[f] for f in fields]).isNotNull()
        turns.append(F.when(said, F.struct(who.alias("role"), F.concat_ws("\n\n", *texts).alias("text"))))
    return F.filter(F.array(*turns), lambda t: t.isNotNull())


def canonical_turns(
    record: Column, layouts: tuple[Layout, ...] = LAYOUTS, print_: Column | None = None
) -> Column:
    """A JSON record's turns as ``array<struct<role, text>>``.

    ``print_`` is the record's fingerprint where a column holds it already, so
    that it isn't made anew for each layout it is compared with.

    The layout is the one with the record's fingerprint. A record of another
    fingerprint that has all field paths of a layout is read by it, further
    fields aside: by the layout of the most paths, then the first; so
    ``{"messages": []}`` has an empty array of turns. A record that holds no
    layout, and one that isn't JSON, has null. Null texts and roles are empty;
    empty fields of a joined text are left out; a part whose fields are all
    null, such as a completion that isn't there, is no turn.
    """
    print_ = fingerprint(record) if print_ is None else print_
    out = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in sorted(reversed(layouts), key=lambda x: x.schema.count("string")):  # the last one asks first
        out = F.when(_holds(layout, record), _turns(layout, record)).otherwise(out)
    for layout in layouts:
        out = F.when(print_ == layout.fingerprint, _turns(layout, record)).otherwise(out)
    return out


def as_layout(name: Column, role: Column, text: Column) -> Column:
    """One turn as a JSON record of the layout of that name (by default, "turn").

    The inverse of ``canonical_turns`` for a single turn, as sources would write
    it. Roles that a layout has no place for keep the layout "turn".
    """
    role, text = (F.coalesce(x, F.lit("")) for x in (role, text))
    ask, answer = (F.when(role == who, text) for who in ("user", "assistant"))
    both = role.isin("user", "assistant")
    keep = {"ignoreNullFields": "false"}
    records = {
        "messages": (F.lit(True), F.struct(F.array(F.struct(role.alias("role"), text.alias("content"))).alias("messages"))),
        "conversations": (both, F.struct(F.array(F.struct(F.when(role == "user", "human").otherwise("gpt").alias("from"), text.alias("value"))).alias("conversations"))),
        "prompt": (both, F.struct(ask.alias("prompt"), answer.alias("completion"))),
        "instruction": (both, F.struct(ask.alias("instruction"), F.lit(None).cast("string").alias("input"), answer.alias("output"))),
        "short instruction": (both, F.struct(ask.alias("instruction"), answer.alias("output"))),
    }
    out = F.to_json(F.struct(role.alias("role"), text.alias("text")))
    for layout, (fits, record) in records.items():
        out = F.when((name == layout) & fits, F.to_json(record, keep)).otherwise(out)
    return out


def escape(text: Column, bars: bool = False) -> Column:
    """Doubles backslashes and breaks control strings after their first character.

    With ``bars``, every bar gets a backslash, too.
    """
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    if bars:
        text = F.replace(text, F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(text, CONTROL, r"$1$3\\$2$4")


def unescape(text: Column) -> Column:
    plain = F.instr(text, "\\") == 0
    return F.when(plain, text).otherwise(F.regexp_replace(text, r"(?s)\\(.)", "$1"))


def format_turns(df: DataFrame, role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``df`` with each turn's ``segment`` and where in it the loss applies.

    ``loss_start`` (from 1) and ``loss_length`` span the escaped text of an
    assistant's turn, in code points; they are null for others. A null role or
    text is empty. Columns of ``df`` with those names are replaced.
    """
    role = escape(F.coalesce(F.col(role_col), F.lit("")), bars=True)
    text = escape(F.coalesce(F.col(text_col), F.lit("")))
    loss = F.col(role_col) == "assistant"
    head = F.concat(F.lit("<|"), role, F.lit("|>\n"))
    return df.drop("segment", "loss_start", "loss_length").select(
        "*",
        F.concat(head, text, F.lit(END)).alias("segment"),
        F.when(loss, F.length(head) + 1).alias("loss_start"),
        F.when(loss, F.length(text)).alias("loss_length"),
    )


def parse_segments(df: DataFrame) -> DataFrame:
    """``df`` of formatted segments with ``role``, ``text`` and ``loss`` read back.

    A role may be of any length: the end of the head is the first bar that no
    escape holds, found once the escapes are blanked out at their full length.
    """
    blank = F.lit("  ")
    bare = F.replace(F.replace("segment", F.lit("\\\\"), blank), F.lit("\\|"), blank)
    end = F.locate("|>\n", bare, 3)
    return df.select(
        *[c for c in df.columns if c not in ("role", "text", "loss")],
        unescape(F.substring("segment", F.lit(3), end - 3)).alias("role"),
        unescape(F.substring("segment", end + 3, F.length("segment") - end - 2 - len(END))).alias("text"),
        unescape(F.substring("segment", F.col("loss_start"), F.col("loss_length"))).alias("loss"),
    )


_DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _DIGESTS.split(", ")]
    types = [pa.string() if x.endswith("string") else pa.int64() for x in _DIGESTS.split(", ")]
    now, out = None, []

    def row():
        return now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5]

    def flush(rows):
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in types]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for conv, role, text, loss, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now[0] != conv:
                if now is not None:
                    out.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[1] += 1
            now[2].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                now[3] += len(loss)
                now[4].update(loss.encode())
            now[5] += chars
        if len(out) > 5000:
            yield flush(out)
            out = []
    if now is not None:
        out.append(row())
    yield flush(out)


def digests(parsed: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Digests of whole conversations, read turn by turn in order.

    The rows of a conversation stream through its hashes; none is gathered.
    Turns with one number are ordered by role, then text; null comes first.
    """
    small_batches(parsed.sparkSession)
    rows = parsed.select(
        F.col(id_col).cast("long").alias("conv_id"),
        F.col(turn_col).alias("_turn"),
        "role", "text", "loss", F.length("segment").cast("long").alias("chars"),
    )
    return (
        rows.repartition("conv_id")
        .sortWithinPartitions("conv_id", "_turn", "role", "text")
        .select("conv_id", "role", "text", "loss", "chars")
        .mapInArrow(_digest, _DIGESTS)
    )
