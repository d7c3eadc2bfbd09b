r"""Chat formatting: layouts told apart by fingerprints, turned into turns, turns into marked text.

A layout's fingerprint is a hash of its nested field paths. Each known fingerprint selects a declarative
mapping that says where roles and texts are; tables are matched by their schema, JSON records one by
one. The result is a row per turn: (conv_id, turn, role, text).

The template writes a turn as ``<|turn|>role\ntext<|end|>\n``. Inside roles and texts ``&`` becomes ``&amp;`` and ``<``
becomes ``&lt;``, so no mark can occur in them, and both can be undone. Formatted turns stay a row each, in
order, with the span that the loss is computed on, so a conversation may have any number of turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
LEARNED_ROLE = "assistant"
TURNS = "conv_id bigint, turn bigint, role string, text string"


@dataclass(frozen=True)
class Layout:
    """Where turns are: ``turns`` names an array of structs with ``role`` and ``text`` fields; without it, ``parts`` are
    (role, field) pairs in order, and empty ones are left out; ``by_row`` says that each row is a turn."""

    name: str
    paths: Sequence[str]  # of nested fields; [] stands for the elements of an array
    turns: str = ""
    role: str = ""
    text: str = ""
    parts: Sequence[tuple[str, str]] = ()
    by_row: bool = False
    roles: Mapping[str, str] = field(default_factory=dict)  # other names of roles


LAYOUTS = (
    Layout("rows", ["conv_id", "turn", "role", "text"], role="role", text="text", by_row=True),
    Layout("messages", ["messages[].role", "messages[].content"], turns="messages", role="role", text="content"),
    Layout(
        "from and value", ["conversations[].from", "conversations[].value"], turns="conversations", role="from", text="value",
        roles={"human": "user", "gpt": "assistant", "bot": "assistant"},
    ),
    Layout("prompt", ["prompt", "response"], parts=[("user", "prompt"), ("assistant", "response")]),
    Layout("prompt and completion", ["prompt", "completion"], parts=[("user", "prompt"), ("assistant", "completion")]),
    Layout("question", ["question", "answer"], parts=[("user", "question"), ("assistant", "answer")]),
    Layout("instruction", ["instruction", "output"], parts=[("user", "instruction"), ("assistant", "output")]),
    Layout(
        "instruction and input", ["instruction", "input", "output"],
        parts=[("system", "instruction"), ("user", "input"), ("assistant", "output")],
    ),
)


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of all values in a type."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(found: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(p.lower() for p in found)).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(layout.paths): layout for layout in LAYOUTS}


def layout_of(df: DataFrame, extra: Sequence[str] = ("conv_id",)) -> Layout:
    """The layout of a table. Columns that no layout names are tried without; ``extra`` ones may be present or not."""
    named = {p.split("[")[0].split(".")[0].lower() for layout in LAYOUTS for p in layout.paths}
    fields = [f for f in df.schema.fields if f.name.lower() in named]
    for left_out in ((), extra):
        kind = T.StructType([f for f in fields if f.name not in left_out])
        layout = BY_FINGERPRINT.get(fingerprint(paths(kind)))
        if layout:
            return layout
    raise ValueError(f"no layout has these fields: {paths(df.schema)}")


def _turn_list(layout: Layout, value) -> Column:
    """array<struct<role, text>> of a record; ``value`` gives the column of a path as a type."""
    if layout.turns:
        kind = f"array<struct<`{layout.role}`: string, `{layout.text}`: string>>"

        def turn(said: Column) -> Column:
            role, text = (said[name].cast("string") for name in (layout.role, layout.text))
            return F.struct(_role(layout, role).alias("role"), text.alias("text"))

        return F.transform(value(layout.turns, kind), turn)
    parts = [F.struct(F.lit(role).alias("role"), value(name, "string").cast("string").alias("text")) for role, name in layout.parts]
    return F.filter(F.array(*parts), lambda t: F.coalesce(t["text"], F.lit("")) != "")


def _role(layout: Layout, role: Column) -> Column:
    for other, name in layout.roles.items():
        role = F.when(F.lower(role) == other, name).otherwise(role)
    return role


def _exploded(records: DataFrame, turns: Column) -> DataFrame:
    each = records.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.posexplode(turns).alias("turn", "said"))
    return each.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "said.role", "said.text")


def turns(df: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) of a table of any known layout, with a conv_id. Null texts are empty, null roles too."""
    layout = layout_of(df)
    if layout.by_row:
        said = df.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), F.col("role").cast("string"), F.col("text").cast("string"))
    else:
        said = _exploded(df, _turn_list(layout, lambda name, _: F.col(name)))
    return said.fillna("", ["role", "text"])


def json_turns(records: DataFrame, column: str = "record") -> DataFrame:
    """Turns of a table (conv_id, JSON text) whose records differ in layout.

    Each record's own schema gives its fingerprint. Records that are null, no JSON, or of no known
    layout have no turns; ``json_layout`` names the layout, to find them.
    """
    said = F.lit(None).cast("array<struct<role: string, text: string>>")
    value = F.try_parse_json(column)
    for layout in LAYOUTS:
        if not layout.by_row:
            own = _turn_list(layout, lambda name, kind: F.try_variant_get(value, f"$.{name}", kind))
            said = F.when(_json_fingerprint(value) == fingerprint(layout.paths), own).otherwise(said)
    return _exploded(records.withColumn("conv_id", F.col("conv_id")), said).fillna("", ["role", "text"])


def json_layout(column: str = "record") -> Column:
    name = F.lit(None).cast("string")
    for layout in LAYOUTS:
        name = F.when(_json_fingerprint(F.try_parse_json(column)) == fingerprint(layout.paths), layout.name).otherwise(name)
    return name


def _json_fingerprint(value: Column) -> Column:
    """Of a record one array of objects deep, from the schema that Spark gives for it."""
    schema = F.schema_of_variant(value)
    inner = r"(\w+): ARRAY<OBJECT<([^<>]*)>>"
    nested = F.transform(
        F.regexp_extract_all(schema, F.lit(inner), F.lit(0)),
        lambda part: F.transform(
            F.regexp_extract_all(F.regexp_extract(part, inner, 2), F.lit(r"(\w+):"), F.lit(1)),
            lambda name: F.concat(F.regexp_extract(part, inner, 1), F.lit("[]."), name),
        ),
    )
    flat = F.regexp_extract_all(F.regexp_replace(schema, inner + "(, )?", ""), F.lit(r"(\w+):"), F.lit(1))
    found = F.transform(F.concat(F.flatten(nested), flat), F.lower)
    return F.sha2(F.array_join(F.array_sort(found), "\n"), 256)


def _escaped(column: str) -> Column:
    return F.replace(F.replace(F.col(column), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: str) -> str:
    return text.replace("&lt;", "<").replace("&amp;", "&")


def formatted(said: DataFrame) -> DataFrame:
    """(conv_id, turn, segment, loss_start, loss_end): the marked text of each turn and, for turns of the learned
    role, the span of its text, in code points. A line end inside a role is written ``&#10;``."""
    role = F.replace(_escaped("role"), F.lit("\n"), F.lit("&#10;"))
    rows = said.select("conv_id", "turn", (F.col("role") == LEARNED_ROLE).alias("learned"), role.alias("role"), _escaped("text").alias("text"))
    start = F.length("role") + len(OPEN) + 1
    return rows.select(
        "conv_id",
        "turn",
        F.concat(F.lit(OPEN), "role", F.lit("\n"), "text", F.lit(CLOSE)).alias("segment"),
        F.when(F.col("learned"), start).alias("loss_start"),
        F.when(F.col("learned"), start + F.length("text")).alias("loss_end"),
    )


def parsed(segment: str) -> tuple[str, str]:
    """Role and text of a formatted turn."""
    if not (segment.startswith(OPEN) and segment.endswith(CLOSE)):
        raise ValueError(f"not a turn: {segment[:40]!r}")
    role, _, text = segment[len(OPEN) : -len(CLOSE)].partition("\n")
    return unescaped(role.replace("&#10;", "\n")), unescaped(text)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


class _Digest:
    def __init__(self) -> None:
        self.turns = self.learned = self.chars = 0
        self.said, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, start: int | None, end: int | None) -> None:
        self.turns += 1
        self.chars += len(segment)
        self.said.update("{}\n{}\n".format(*parsed(segment)).encode())
        if start is not None:
            text = unescaped(segment[start:end])
            self.learned += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.turns, self.said.hexdigest(), self.learned, self.loss.hexdigest(), self.chars


def digests(segments: DataFrame) -> DataFrame:
    """Per conversation, from formatted turns: number and digest of turns, length and digest of the text under the loss.

    Turns are read in order of (turn, segment), nulls first; a conversation passes through its task turn by
    turn and is never held whole. Rows without conv_id are one conversation.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        conversation, digest = None, None
        for batch in batches:
            done = []
            for conv_id, segment, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if digest is None or conv_id != conversation:
                    if digest:
                        done.append((conversation, *digest.row()))
                    conversation, digest = conv_id, _Digest()
                digest.add(segment, start, end)
            if done:
                yield out(done)
        if digest:
            yield out([(conversation, *digest.row())])

    ordered = segments.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(read, DIGESTS)


def tricky(spark: SparkSession) -> DataFrame:
    """A conversation whose texts look like marks of templates."""
    text = r"\### Assistant: </turn> ok"
    return spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], TURNS)
