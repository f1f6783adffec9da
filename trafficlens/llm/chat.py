"""Chat formatting by schema fingerprints.

A record of any layout arrives as JSON. The paths of its nested fields that any mapping names are hashed; the
fingerprint selects a declarative mapping which says where the turns are: in one array of messages, or in
fields of their own such as prompt and response, or instruction, input and output. The turns are written in
a template, together with the code point spans that a loss is taken over, and can be read back from it.

Template of a turn: `### Role: text </turn>` and a line feed, with the role as it is. Within roles and texts
`\\` becomes `\\b`, `###` becomes `\\h`, `</turn>` becomes `\\t`, and in roles `: ` becomes `\\c`. A backslash
in the output therefore always begins such a pair, marks are found by plain search, and undoing the pairs
with the backslash last gives the text back whatever it holds.

Defined cases: null texts and roles are empty, and a field that is null is still there; fields no mapping names do
not matter, texts may be of any length, and numbers or nested values are taken as their JSON text; a record without turns, a layout without mapping, or invalid
JSON gives no turns and `layout` null, and the row stays; turns of one number are in order of role and
text; empty tables give empty results; columns besides the named ones are passed on by `canonical` only.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template and what stands for them inside texts, in the order of escaping.
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
ESCAPES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_ESCAPES = [*ESCAPES, (": ", "\\c")]

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns are: either an array of objects, with the names of its role and text fields, or (role, name)
    pairs of single fields. `paths` are the nested field paths a record of this layout has."""

    name: str
    array: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def paths(self) -> list[str]:
        if self.array:
            top, *inner = self.array
            return sorted([top, *[f"{top}[].{field}" for field in inner]])
        return sorted(name for _, name in self.fields)


def _messages(name: str, top: str, role: str, text: str) -> Layout:
    return Layout(name, array=(top, role, text))


def _fields(name: str, *turns: tuple[str, str]) -> Layout:
    return Layout(name, fields=turns)


LAYOUTS = [
    _messages("messages", "messages", "role", "content"),
    _messages("conversations", "conversations", "from", "value"),
    _fields("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _fields("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _fields("question_answer", ("user", "question"), ("assistant", "answer")),
    _fields("instruction", ("user", "instruction"), ("assistant", "output")),
    _fields("instruction_input", ("system", "instruction"), ("user", "input"), ("assistant", "output")),
]

# Names that sources use for the roles.
ROLE_NAMES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


# Texts may be as long as a value can be.
_OPTIONS = {"maxStringLen": str(2**31 - 1)}
_OBJECT = "map<string,string>"


def _objects(record: Column, top: str) -> Column:
    """The array of objects in field `top`; null if it holds anything else."""
    return F.from_json(record[top], f"array<{_OBJECT}>", _OPTIONS)


def fingerprint(record: Column, layouts: list[Layout]) -> Column:
    """Hash of the nested field paths of a record (a map of its fields) that any of `layouts` names: other fields
    tell nothing. A path is there when its field is, whatever it holds, null too."""

    def holds(inner: str):
        return lambda x: F.coalesce(F.map_contains_key(x, F.lit(inner)), F.lit(False))

    has = {}
    for layout in layouts:
        for path in layout.paths:
            top, _, inner = path.partition("[].")
            there = F.map_contains_key(record, F.lit(top))
            if inner:
                there = F.exists(_objects(record, top), holds(inner))
            has[path] = F.coalesce(there, F.lit(False))
    found = F.concat_ws(",", *[F.when(has[path], F.lit(path)) for path in sorted(has)])
    return F.xxhash64(found)


def _turns_of(layout: Layout, record: Column) -> Column:
    text = lambda fields, name: F.coalesce(fields[name], F.lit(""))
    if layout.array:
        top, role, said = layout.array
        return F.transform(_objects(record, top), lambda m: F.struct(text(m, role).alias("role"), text(m, said).alias("text")))
    return F.array(*[F.struct(F.lit(role).alias("role"), text(record, name).alias("text")) for role, name in layout.fields])


def _named(turns: Column) -> Column:
    role = lambda t: F.coalesce(F.create_map(*[F.lit(x) for pair in ROLE_NAMES.items() for x in pair])[t["role"]], t["role"])
    return F.transform(turns, lambda t: F.struct(role(t).alias("role"), t["text"].alias("text")))


def canonical(records: DataFrame, json_col: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """`records` with `layout` (null: none fits) and `turns`, an array of (role, text)."""
    fields = F.from_json(json_col, _OBJECT, _OPTIONS)
    read = records.withColumn("_record", fields).withColumn("_print", fingerprint(F.col("_record"), layouts))
    layout, turns = F.lit(None).cast("string"), F.array().cast(TURNS)
    for one in layouts:
        fits = F.col("_print") == F.xxhash64(F.lit(",".join(one.paths)))
        layout = F.when(fits, F.lit(one.name)).otherwise(layout)
        turns = F.when(fits, _turns_of(one, F.col("_record")).cast(TURNS)).otherwise(turns)
    found = read.withColumns({"layout": layout, "turns": F.coalesce(_named(turns), F.array().cast(TURNS))})
    return found.drop("_record", "_print")


def _escaped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def _unescaped(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def formatted(turns_of: DataFrame, *, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds `formatted` and `loss_spans`: 0-based (start, length) in code points of the texts, as escaped, of
    `loss_roles`."""
    pieces = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), _escaped(t["role"], ROLE_ESCAPES), F.lit(MIDDLE)).alias("head"),
            _escaped(t["text"], ESCAPES).alias("body"),
            t["role"].isin(*loss_roles).alias("loss"),
        ),
    )
    out = turns_of.withColumn("_pieces", pieces)
    sizes = F.transform(
        "_pieces",
        lambda p: F.struct(
            F.char_length(p["head"]).cast("long").alias("head"), F.char_length(p["body"]).cast("long").alias("body"), p["loss"].alias("loss")
        ),
    )
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    span = lambda at, s: F.array(F.struct((at + s["head"]).alias("start"), s["body"].alias("length")))
    placed = F.aggregate(
        sizes,
        start,
        lambda acc, s: F.struct(
            (acc["at"] + s["head"] + s["body"] + len(CLOSE)).alias("at"),
            F.when(s["loss"], F.concat(acc["spans"], span(acc["at"], s))).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    text = F.array_join(F.transform("_pieces", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "")
    return out.withColumns({"formatted": text, "loss_spans": placed}).drop("_pieces")


def read_back(text: Column) -> Column:
    """Turns of a formatted text."""
    parts = F.split(text, CLOSE.replace("/", "\\/"), -1)
    whole = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    # The role ends at the first middle mark: its own are escaped.
    head = lambda p: F.substring_index(p, MIDDLE, 1)
    body = lambda p: F.substring(p, F.char_length(head(p)) + len(MIDDLE) + 1, 2**31 - 1)
    role = lambda p: F.substring(head(p), len(OPEN) + 1, 2**31 - 1)
    return F.transform(
        whole, lambda p: F.struct(_unescaped(role(p), ROLE_ESCAPES).alias("role"), _unescaped(body(p), ESCAPES).alias("text"))
    )


def loss_text(text: Column, spans: Column) -> Column:
    """All text of a formatted text under the loss spans, unescaped."""
    under = F.transform(spans, lambda s: F.substring(text, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(under, lambda p: _unescaped(p, ESCAPES)), "")


def digests(formatted_turns: DataFrame, key: str) -> DataFrame:
    """What can be read back from `formatted` and `loss_spans`, as counts and digests."""
    back = formatted_turns.select(
        key, "formatted", read_back(F.col("formatted")).alias("_turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("_loss")
    )
    turns = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        key,
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def records_of_rows(rows: DataFrame, *, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One JSON record per `key` from rows of single turns: as prompt and response, or as instruction, input and
    output, where the roles allow it, else as messages."""
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("content")
    )
    turns = rows.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("_turns"))
    roles = F.array_join(F.transform("_turns", lambda t: t["role"]), ",")
    content = lambda i: F.col("_turns")[i]["content"]
    message = F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    json = (
        F.when(roles == "user,assistant", F.to_json(F.struct(content(0).alias("prompt"), content(1).alias("response"))))
        .when(
            roles == "system,user,assistant",
            F.to_json(F.struct(content(0).alias("instruction"), content(1).alias("input"), content(2).alias("output"))),
        )
        .otherwise(F.to_json(F.struct(message.alias("messages"))))
    )
    return turns.select(key, json.alias("record"))
