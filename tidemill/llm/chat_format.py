"""Chat formatting: a fingerprint of the nested field paths of a record selects the mapping to canonical turns.

All of it is column expressions: no Python runs on the rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from tidemill.llm.helpers import quoted

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """One record layout: which field paths it has, and how they become turns.

    ``single`` lists ``(role, path)`` in turn order: each field that is present is one turn. ``many`` names an array of
    structs with its role and text field. ``row`` names the role and the text field of records that are one turn each.
    A path is present when its value is not null, in an array when any element has it.
    """

    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    single: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None
    row: tuple[str, str] | None = None

    def fingerprints(self) -> list[str]:
        """Of every set of present paths that this layout covers."""
        sets = (c for n in range(len(self.optional) + 1) for c in combinations(self.optional, n))
        return [fingerprint_of((*self.required, *extra)) for extra in sets]


# The layouts in common use.
LAYOUTS = (
    Layout("turn_rows", (), ("role", "text"), row=("role", "text")),
    Layout("messages", ("messages[].role",), ("messages[].content",), many=("messages", "role", "content")),
    Layout("conversations", ("conversations[].from",), ("conversations[].value",), many=("conversations", "from", "value")),
    Layout("prompt_response", ("prompt", "response"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), (("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("question_answer", ("question", "answer"), (), (("user", "question"), ("assistant", "answer"))),
)
# Role names that mean the same.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint_of(paths: Iterable[str]) -> str:
    """Hash of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()


def leaf_paths(kind: DataType, at: str = "") -> list[str]:
    """Nested field paths of a type, ``[]`` for the elements of an array."""
    if isinstance(kind, StructType):
        return [p for f in kind.fields for p in leaf_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, ArrayType):
        return leaf_paths(kind.elementType, f"{at}[]")
    return [at]


def value_at(path: str) -> Column:
    """The value of a path without arrays."""
    return F.col(".".join(f"`{part}`" for part in path.split(".")))


def present(path: str) -> Column:
    """Whether a row has a value at the path."""
    if "[]." not in path:
        return value_at(path).isNotNull()
    array, field = path.split("[].", 1)
    return F.coalesce(F.exists(value_at(array), lambda e: e[field].isNotNull()), F.lit(False))


def record_fingerprint(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> Column:
    """Hash of the paths that a row has, among those that any layout names; other columns don't matter."""
    wanted = {p for x in layouts for p in (*x.required, *x.optional)}
    paths = sorted(wanted & set(leaf_paths(df.schema)))
    return F.sha2(F.array_join(F.array_compact(F.array(*[F.when(present(p), F.lit(p)) for p in paths])), "\n"), 256)


def _turns(layout: Layout, known: set[str]) -> Column:
    def turn(role: Column, text: Column) -> Column:
        return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))

    def at(path: str) -> Column:
        return value_at(path).cast("string") if path in known else F.lit(None).cast("string")

    if layout.row:
        return F.array(turn(at(layout.row[0]), at(layout.row[1])))
    if layout.many:
        array, role, text = layout.many
        has_text = f"{array}[].{text}" in known
        return F.transform(value_at(array), lambda e: turn(e[role], e[text] if has_text else F.lit("")))
    turns = [F.when(at(path).isNotNull(), turn(F.lit(role), at(path))) for role, path in layout.single]
    return F.array_compact(F.array(*turns))


def canonical_turns(records: DataFrame, layouts: Sequence[Layout] = LAYOUTS, roles: dict[str, str] = ROLES) -> DataFrame:
    """``records`` plus ``layout`` (name) and ``turns`` (array of role and text), mapped by the fingerprint of each row.

    A row whose set of paths fits no layout keeps null in both, so it can be found; none is dropped. Null texts and
    roles are empty. Columns that are no path of a layout pass through; existing ``layout`` and ``turns`` are replaced.
    """
    known = set(leaf_paths(records.schema))
    usable = [x for x in layouts if set(x.required) <= known]
    mark = record_fingerprint(records, layouts)
    name = F.lit(None).cast("string")
    turns = F.lit(None).cast(TURNS)
    for x in reversed(usable):
        fits = mark.isin(x.fingerprints())
        name = F.when(fits, F.lit(x.name)).otherwise(name)
        turns = F.when(fits, _turns(x, known).cast(TURNS)).otherwise(turns)
    renamed = F.create_map(*[F.lit(v) for pair in roles.items() for v in pair]) if roles else None

    def canonical(t: Column) -> Column:
        role = F.coalesce(renamed[t["role"]], t["role"]) if roles else t["role"]
        return F.struct(role.alias("role"), t["text"].alias("text"))

    return records.withColumns({"layout": name, "turns": turns}).withColumn("turns", F.transform("turns", canonical))


# --- template -------------------------------------------------------------------------------------------------------

START, END, LINE = "<|im_start|>", "<|im_end|>", "<|nl|>"


def escape(text: Column) -> Column:
    """Doubles the bar of every ``<|``: no control string is left, and ``unescape`` gives the text back."""
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _role_out(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def _role_in(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(LINE), F.lit("\n")))


def format_chats(turns: DataFrame, key: str, order: Sequence[str], train_on: str = "assistant") -> DataFrame:
    """One chat per key: ``(key, formatted, spans)`` from rows of canonical ``turns``.

    Rows of a key are taken by ``order``, ties by their turns; rows without turns add nothing, but a key that has none
    at all stays, with an empty chat. Null is a key of its own. ``spans`` has, for each turn, the code points
    ``[start, start + length)`` of its text in ``formatted`` and whether it counts for the loss. Offsets are running
    sums of a window, so the work is linear in the length of a chat; the rows of one chat meet in one task, as its
    output is one value.
    """
    flat = turns.select(
        quoted(key).alias("key"), F.struct(*[quoted(c).alias(f"o{i}") for i, c in enumerate(order)]).alias("o"),
        F.posexplode_outer("turns").alias("pos", "turn"),
    )
    header = F.concat(F.lit(START), _role_out(F.col("turn.role")), F.lit("\n"))
    body = escape(F.col("turn.text"))
    pieces = flat.select(
        "key", "o", F.coalesce("pos", F.lit(-1)).alias("pos"), F.col("turn").isNull().alias("none"),
        F.coalesce(header, F.lit("")).alias("header"), F.coalesce(body, F.lit("")).alias("body"),
        F.coalesce(F.col("turn.role") == train_on, F.lit(False)).alias("loss"),
    )
    sequence = ("o", "pos", "header", "body")
    running = Window.partitionBy("key").orderBy(*sequence).rowsBetween(Window.unboundedPreceding, -1)
    piece = F.when(F.col("none"), F.lit("")).otherwise(F.concat("header", "body", F.lit(f"{END}\n")))
    placed = pieces.withColumn("piece", piece).withColumn(
        "start", (F.coalesce(F.sum(F.char_length("piece")).over(running), F.lit(0)) + F.char_length("header")).cast("bigint"))
    collected = F.array_sort(F.collect_list(F.when(~F.col("none"), F.struct(
        "start", F.char_length("body").cast("bigint").alias("length"), "loss", "piece"))))
    return placed.groupBy("key").agg(collected.alias("all")).select(
        F.col("key").alias(key), F.array_join(F.col("all.piece"), "").alias("formatted"),
        F.transform("all", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"), x["loss"].alias("loss"))).alias("spans"),
    )


def read_back(formatted: Column, spans: Column) -> Column:
    """The turns of a formatted chat, unescaped: array of role, text and loss."""
    pieces = F.split(formatted, r"\Q" + START + r"\E", -1)
    segments = F.slice(pieces, F.lit(2), F.size(pieces) - 1)

    def turn(segment: Column, span: Column) -> Column:
        head = F.substring_index(segment, "\n", 1)
        text = F.substring(segment, F.char_length(head) + 2, span["length"].cast("int"))
        return F.struct(_role_in(head).alias("role"), unescape(text).alias("text"), span["loss"].alias("loss"))

    return F.zip_with(segments, spans, turn)
