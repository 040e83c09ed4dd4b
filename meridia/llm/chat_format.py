"""Chat formatting by schema fingerprints, in Spark expressions only.

A record's own nested field paths are hashed, each and all together. The hashes of the
paths select a declarative mapping that turns the record into canonical turns; the hash
of all of them is its fingerprint, which tells the schemas of a corpus apart. Turns are
formatted by a template of control strings; control strings inside texts are escaped,
so that the formatted text can be read back exactly.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType

# The template's own control strings, and those of common chat templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
ESCAPE = "\\"
#: Role names of other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}

RECORD = (
    "messages array<struct<role: string, content: string>>, conversations array<struct<`from`: string, value: string>>, "
    "system string, instruction string, input string, output string, prompt string, response string, completion string, question string, answer string"
)
TURNS = "array<struct<role: string, text: string>>"


@dataclass(frozen=True)
class Layout:
    """Paths that a record of the layout has, single fields that it may have, and its turns.

    `each` names the array whose elements are turns with the fields `role` and `text`;
    `parts` are (role, path) of single fields, joined by a blank line within one role.
    """

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...] = ()
    each: tuple[str, str, str] | None = None
    parts: tuple[tuple[str, str], ...] = ()


LAYOUTS = (
    Layout("messages", ("messages",), ("system",), each=("messages", "role", "content"), parts=(("system", "system"),)),
    Layout("from_value", ("conversations",), ("system",), each=("conversations", "from", "value"), parts=(("system", "system"),)),
    Layout("instruction", ("instruction", "output"), ("input", "system"), parts=(("system", "system"), ("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt_response", ("prompt", "response"), ("system",), parts=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("prompt_completion", ("prompt", "completion"), ("system",), parts=(("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
    Layout("question_answer", ("question", "answer"), ("system",), parts=(("system", "system"), ("user", "question"), ("assistant", "answer"))),
)


#: Levels of objects whose fields are paths.
DEPTH = 3


def _paths_of(value: Column, prefix: Column, depth: int) -> Column:
    """The paths in a variant: an object's fields, and the fields of objects inside it and inside its arrays."""
    none = F.array().cast("array<string>")
    if not depth:
        return none
    fields = F.map_entries(F.try_variant_get(value, "$", "map<string, variant>"))
    filled = F.filter(F.coalesce(fields, F.array().cast("array<struct<key: string, value: variant>>")), lambda e: e["value"].isNotNull() & ~F.is_variant_null(e["value"]))

    def below(e: Column) -> Column:
        path = F.concat(prefix, e["key"])
        elements = F.coalesce(F.try_variant_get(e["value"], "$", "array<variant>"), F.array().cast("array<variant>"))
        inside = F.flatten(F.transform(elements, lambda x: _paths_of(x, F.concat(path, F.lit("[].")), depth - 1)))
        return F.concat(F.array(path), _paths_of(e["value"], F.concat(path, F.lit(".")), depth - 1), inside)

    return F.array_distinct(F.flatten(F.transform(filled, below)))


def nested_paths(json: Column) -> Column:
    """The nested paths, in order of name, of a JSON object's fields that are not null; none for null, other JSON, text that is no JSON and objects that repeat a name."""
    return F.array_sort(_paths_of(F.try_parse_json(json), F.lit(""), DEPTH))


#: Bytes of JSON from which a record may not fit into a variant, whose own limit depends on its values.
VARIANT_BYTES = 16 << 20


def _record_paths(record: Column, json: Column) -> Column:
    """The paths of a parsed RECORD: its own fields that are not null, with those of their elements, and the other names of the JSON object."""
    none = F.array().cast("array<string>")
    has = lambda f: lambda e: e[f].isNotNull()
    kinds = {f.name: f.dataType for f in DataType.fromDDL(RECORD).fields}
    own = []
    for name, kind in kinds.items():
        paths = [F.lit(name)]
        if isinstance(kind, ArrayType):
            paths += [F.when(F.exists(record[name], has(f)), F.lit(f"{name}[].{f}")) for f in kind.elementType.names]
        own.append(F.when(record[name].isNotNull(), F.array_compact(F.array(*paths))).otherwise(none))
    others = F.array_except(F.json_object_keys(json), F.array(*[F.lit(n) for n in kinds]))
    return F.array_sort(F.coalesce(F.concat(*own, others), none))


def fingerprint(paths: Column) -> Column:
    """One hash of all the paths of a record."""
    return F.xxhash64(F.concat_ws("\n", paths))


def _layout_of(paths: Column) -> Column:
    """The number of the first layout all of whose needed paths have their hashes among those of the record's paths, or null."""
    held = F.transform(paths, lambda p: F.xxhash64(p))
    chain = F.lit(None).cast("int")
    for i, layout in reversed(list(enumerate(LAYOUTS))):
        needed = F.array(*[F.xxhash64(F.lit(p)) for p in layout.needs])
        chain = F.when(F.size(F.array_except(needed, held)) == 0, F.lit(i)).otherwise(chain)
    return chain


def _turns_of(layout: Layout, record: Column) -> Column:
    roles = [r for i, (r, _) in enumerate(layout.parts) if r not in [x for x, _ in layout.parts[:i]]]
    single = []
    for role in roles:
        texts = [record[p] for r, p in layout.parts if r == role]
        filled = F.array_compact(F.array(*[F.when(t != "", t) if len(texts) > 1 else t for t in texts]))
        optional = all(p in layout.may for r, p in layout.parts if r == role)
        turn = F.array(F.struct(F.lit(role).alias("role"), F.array_join(filled, "\n\n").alias("text")))
        single.append(F.when(F.size(filled) > 0, turn).otherwise(F.array().cast(TURNS)) if optional else turn)
    if layout.each:
        array, role_field, text_field = layout.each
        alias = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
        name = lambda e: F.coalesce(F.element_at(alias, F.coalesce(e[role_field], F.lit(""))), e[role_field], F.lit(""))
        if layout.name == "messages":
            name = lambda e: F.coalesce(e[role_field], F.lit(""))
        single.append(F.transform(record[array], lambda e: F.struct(name(e).alias("role"), F.coalesce(e[text_field], F.lit("")).alias("text"))))
    return F.concat(*[s.cast(TURNS) for s in single])


def canonical_turns(records: DataFrame, json_col: str, carry: list[str]) -> DataFrame:
    """(carried columns, fingerprint, layout, turns) of records in JSON.

    turns is an array of (role, text). A null role or text in a turn is empty. Of several
    layouts that a record has, the first of LAYOUTS counts; further fields, whatever their
    names, change the fingerprint and nothing else. A record that is null, no JSON object,
    or of no layout has a null layout and no turns. A record too large for a variant (128 MB
or so) has its layout and turns too; its fingerprint knows the paths of the layouts'
own fields and the names of other top-level fields, be they null or not.
    """
    json = F.col(json_col)  # the parser's own bound on a string is 20 million characters
    parsed = records.select(*carry, F.from_json(json, RECORD, {"maxStringLen": str(2**31 - 1)}).alias("record"), json.alias("json"))
    parsed = parsed.select(*carry, "record", F.when((F.octet_length("json") > VARIANT_BYTES) & F.try_parse_json("json").isNull(), _record_paths(F.col("record"), F.col("json"))).otherwise(nested_paths(F.col("json"))).alias("paths"))
    laid = parsed.select(*carry, "record", fingerprint(F.col("paths")).alias("fingerprint"), _layout_of(F.col("paths")).alias("number"))
    turns = F.array().cast(TURNS)
    for i, layout in enumerate(LAYOUTS):
        turns = F.when(F.col("number") == i, _turns_of(layout, F.col("record"))).otherwise(turns)
    names = F.array(*[F.lit(x.name) for x in LAYOUTS])
    return laid.select(*carry, "fingerprint", F.get(names, F.col("number")).alias("layout"), turns.alias("turns"))


def escape(text: Column) -> Column:
    """text with escape characters doubled and one put into every control string."""
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + ESCAPE + c[1:])), CONTROLS, F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE * 2)))


def unescape(text: Column) -> Column:
    """The text that escape() was given."""
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def _fold(turns: Column, step: Callable[[Column, Column], Column], start: Column) -> Column:
    return F.aggregate(turns, start, step)


def format_turns(df: DataFrame, turns_col: str = "turns", carry: tuple[str, ...] = ("conv_id",), loss_role: str = "assistant") -> DataFrame:
    """(carried columns, formatted, loss_spans): the template's text and the code points, from 0 and
    end exclusive, that bear loss: the texts of loss_role. No turns give an empty text."""
    shown = F.transform(F.col(turns_col), lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == loss_role).alias("loss")))
    pieces = df.select(*carry, shown.alias("shown"))
    formatted = F.array_join(F.transform("shown", lambda t: F.concat(F.lit(TURN), t["role"], F.lit(TEXT), t["text"], F.lit(END))), "")

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + len(TURN) + F.char_length(t["role"]) + len(TEXT)
        end = start + F.char_length(t["text"])
        spans = F.when(t["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["spans"])
        return F.struct((end + len(END)).alias("at"), spans.alias("spans"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))
    return pieces.select(*carry, formatted.alias("formatted"), _fold(F.col("shown"), step, none)["spans"].alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The canonical turns of a formatted text."""
    parts = F.slice(F.split(formatted, r"\Q" + END + r"\E", -1), 1, F.greatest(F.size(F.split(formatted, r"\Q" + END + r"\E", -1)) - 1, F.lit(0)))

    def turn(part: Column) -> Column:
        role_and_text = F.substring(part, len(TURN) + 1, 2**31 - 1)
        role = F.substring_index(role_and_text, TEXT, 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substr(role_and_text, F.char_length(role) + len(TEXT) + 1)).alias("text"))

    return F.transform(parts, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["end"] - s["start"]))), "")


def conversation_records(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, record): each conversation's rows, by turn, as a JSON record in the layout that fits it.

    A question and its answer, with or without a system text before them, are a prompt
    and a response; all else are messages. Null roles and texts are empty; rows with
    equal turns are ordered by role and text, null turns come first, and rows with a null
    id make one conversation. A conversation is one record and one row of output, so its
    turns meet in one task. An empty table gives no records; other columns are not read.
    """
    message = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    grouped = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(message)).alias("m"))
    roles = F.array_join(F.transform("m", lambda t: F.replace(t["role"], F.lit(" "), F.lit("_"))), " ")
    content = lambda i: F.get("m", F.lit(i))["content"]
    pair = F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response")))
    led = F.to_json(F.struct(content(0).alias("system"), content(1).alias("prompt"), content(2).alias("response")))
    messages = F.to_json(F.struct(F.transform("m", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages")))
    return grouped.select("conv_id", F.when(roles == "user assistant", pair).when(roles == "system user assistant", led).otherwise(messages).alias("record"))
