"""Validation of JSON payloads against field rules: every violation of a row at once, typed values, accepted and refused rows.

A schema is a list of :class:`Field` and of cross-field rules.  All of it becomes a few projections: payload and values are read once, and the table
splits by whether a row has violations.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semistructured import kind_of, member

BLANKS = " \t\r\n\x0b\x0c"
NUMBER = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"


@dataclass
class Field:
    """A field of a payload and its rules.

    ``kind``: ``text`` (trimmed), ``number``, ``flag`` or ``list`` (of ``item`` texts or positive whole numbers).  ``loose`` numbers take numeric texts,
    an empty one and null as 0.  A missing field takes ``default`` or, if it is neither ``optional`` nor ``nullable``, is a violation; ``blank`` takes missing and
    empty texts as null.
    """

    name: str
    kind: str = "text"
    low: float | None = None
    high: float | None = None
    whole: bool = False
    loose: bool = False
    choices: tuple[str, ...] = ()
    pattern: str | None = None
    default: object = None
    optional: bool = False
    nullable: bool = False
    blank: bool = False
    item: str = "text"
    path: str | None = None  # where it is below the payload, with dots

    def raw(self, payload: Column) -> Column:
        """What the payload holds for the field."""
        out = payload
        for part in (self.path or self.name).split("."):
            out = member(out, part)
        return out

    def value(self, raw: Column, kind: Column, text: Column) -> Column:
        """The typed value of a raw one of some :func:`kind_of` and trimmed ``text``; null where the kind does not fit."""
        if self.kind == "number" and self.loose:
            value = F.when((kind == "VOID") | ((kind == "STRING") & (text == "")), 0.0).when((kind == "NUMBER") | _numeric(kind, text), F.try_variant_get(raw, "$", "double"))
            return F.when(kind == "BOOLEAN", F.try_variant_get(raw, "$", "boolean").cast("double")).otherwise(value)
        cast = {"text": text, "number": F.try_variant_get(raw, "$", "double"), "flag": F.try_variant_get(raw, "$", "boolean"), "list": F.try_variant_get(raw, "$", "array<string>")}
        return F.when(kind == KINDS[self.kind], cast[self.kind])

    def missing(self, raw: Column, kind: Column) -> Column:
        return raw.isNull() | ((kind == "STRING") & (F.try_variant_get(raw, "$", "string") == "")) if self.blank else raw.isNull()

    def filled(self, value: Column, missing: Column) -> Column:
        """The value or what stands for a missing one."""
        return F.when(missing, F.lit(self.default)).otherwise(value) if self.default is not None else F.when(~missing, value)

    def faults(self, raw: Column, kind: Column, text: Column, value: Column, missing: Column) -> list[tuple[str, Column]]:
        """The violations with the condition of each."""
        null = kind == "VOID"
        if self.kind == "number" and self.loose:
            wrong = ~(null | kind.isin("NUMBER", "BOOLEAN") | _numeric(kind, text))
        else:
            wrong = ~(kind == KINDS[self.kind]) & ~(null & F.lit(self.nullable or self.blank))
        rules = [("required", missing & F.lit(self.default is None and not (self.optional or self.blank))), ("type", ~missing & wrong)]
        measure = {"text": F.length(value), "number": value, "list": F.size(value)}.get(self.kind)
        if self.low is not None:
            rules.append(("too_small", measure < self.low))
        if self.high is not None:
            rules.append(("too_big", measure > self.high))
        if self.whole:
            rules.append(("not_whole", value != F.floor(value)))
        if self.choices:
            rules.append(("choice", ~value.isin(*self.choices)))
        if self.pattern:
            rules.append(("pattern", ~value.rlike(self.pattern)))
        if self.kind == "list":
            good = (lambda x: kind_of(x) == "STRING") if self.item == "text" else (lambda x: (kind_of(x) == "NUMBER") & (F.try_variant_get(x, "$", "double") > 0) & (F.try_variant_get(x, "$", "double") % 1 == 0))
            held = F.when(kind == "ARRAY", F.try_variant_get(raw, "$", "array<variant>"))
            rules.append(("item", F.exists(held, lambda x: ~F.coalesce(good(x), F.lit(False)))))
        return [(code, condition if code in ("required", "type") else condition & ~missing) for code, condition in rules]


KINDS = {"text": "STRING", "number": "NUMBER", "flag": "BOOLEAN", "list": "ARRAY"}


def _numeric(kind: Column, text: Column) -> Column:
    return (kind == "STRING") & ((text == "") | text.rlike(NUMBER))


@dataclass
class Schema:
    """Fields, whether other keys are refused, and rules over several fields: (name, condition on the values that is a violation)."""

    fields: list[Field]
    strict: bool = True
    rules: list[tuple[str, Callable[[dict[str, Column]], Column]]] = field(default_factory=list)


def checked(df: DataFrame, payload_col: str, schema: Schema) -> DataFrame:
    """Add ``row`` (the typed values; null if refused), ``violations`` (all, as ``field:code``, in order) and ``accepted``.

    ``payload_col`` holds JSON texts; one that is no object has the single violation ``payload:object``.  Cross-field rules are judged where no field is at fault.
    """
    fields = {f"_{i}": f for i, f in enumerate(schema.fields)}
    of = lambda part: {c: F.col(c + part) for c in fields}
    add = lambda rows, part, make: rows.withColumns({c + part: make(c, f) for c, f in fields.items()})
    parsed = df.withColumn("_payload", F.try_parse_json(payload_col)).withColumn("_keys", F.map_keys(F.try_variant_get("_payload", "$", "map<string,variant>")))
    # each step is a projection of its own, so that what later steps read often is computed once a row
    steps = add(parsed, "raw", lambda c, f: f.raw(F.col("_payload")))
    steps = steps.withColumns({f"{c}{part}": make(F.col(f"{c}raw")) for c in fields for part, make in (("kind", kind_of), ("text", lambda x: F.btrim(F.try_variant_get(x, "$", "string"), F.lit(BLANKS))))})
    raw, kind, text, value, missing = map(of, ("raw", "kind", "text", "value", "missing"))
    steps = add(add(steps, "missing", lambda c, f: f.missing(raw[c], kind[c])), "value", lambda c, f: f.value(raw[c], kind[c], text[c]))
    steps = add(steps, "filled", lambda c, f: f.filled(value[c], missing[c]))
    values = {f.name: F.col(f"{c}filled") for c, f in fields.items()}
    faults = [F.when(condition, F.lit(f"{f.name}:{code}")) for c, f in fields.items() for code, condition in f.faults(raw[c], kind[c], text[c], value[c], missing[c])]
    if schema.strict:
        unknown = F.array_sort(F.array_except("_keys", F.array(*[F.lit(f.name) for f in schema.fields])))
        more = F.transform(unknown, lambda k: F.concat(k, F.lit(":unknown_key")))
    else:
        more = F.array().cast("array<string>")
    crossed = F.array_compact(F.array(*[F.when(rule(values), F.lit(name)) for name, rule in schema.rules])) if schema.rules else F.array().cast("array<string>")
    single = steps.withColumn("_single", F.concat(F.array_compact(F.array(*faults)), more))
    of_object = F.when(F.size("_single") > 0, F.col("_single")).otherwise(crossed)
    violations = F.when(F.col("_keys").isNotNull(), of_object).otherwise(F.array(F.lit("payload:object")))
    out = single.withColumn("violations", violations).withColumn("accepted", F.size("violations") == 0)
    typed = F.struct(*[v.alias(name) for name, v in values.items()])
    return out.withColumn("row", F.when(F.col("accepted"), typed)).select(*df.columns, "violations", "accepted", "row")


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows with their typed values as columns, and refused rows with their violations; give it a written table to parse payloads once."""
    others = [c for c in df.columns if c not in ("row", "violations", "accepted")]
    return df.filter("accepted").select(*others, "row.*"), df.filter("not accepted").select(*others, "violations")


#: The choices of the forms.
STATUSES = ("Not Started", "Sampled", "In Progress", "Slept", "Completed")
PRIORITIES = ("Low", "Medium", "High", "Must Play")
PRESET_NAMES = ("nearly-finished", "quick-wins", "recently-played", "fallen-off", "long-haul", "endless-rotation", "untouched", "backlog", "in-progress", "must-play", "short", "unplayed")
SESSIONS, MOODS, GOALS = ("short", "evening", "weekend"), ("brain-off", "chill", "intense"), ("new", "finish", "surprise")

GAME = Schema(
    [
        Field("title", low=1, high=220), Field("genre", high=80, default="Unknown"), Field("store", high=80, default="Steam"), Field("ownership", choices=("Owned",), default="Owned"),
        Field("status", choices=STATUSES, default="Not Started"), Field("rating", "number", 0, 10, whole=True, loose=True, default=0.0), Field("hours_played", "number", 0, loose=True, default=0.0),
        Field("completion_percentage", "number", 0, 100, whole=True, loose=True, default=0.0), Field("priority", choices=PRIORITIES, default="Medium"),
        Field("date_added", high=64, blank=True), Field("last_played_at", high=64, blank=True), Field("notes", high=5000, default=""), Field("steam_appid", pattern=r"^[0-9]{1,10}$", blank=True),
    ]
)

UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _chosen(v: dict[str, Column]) -> Column:
    return sum((v[c].isNotNull().cast("int") for c in ("session", "mood", "goal")), F.lit(0))


def _of_collection(v: dict[str, Column]) -> Column:
    return F.coalesce(v["collection_id"], F.lit("")) != ""


#: Draws: of a collection without filters; guided with all three choices; quick with none and no genres.
DRAW = Schema(
    [
        Field("game_id", pattern=UUID), Field("steam_app_id", "number", 1, whole=True), Field("session", choices=SESSIONS, nullable=True), Field("mood", choices=MOODS, nullable=True),
        Field("goal", choices=GOALS, nullable=True), Field("collection_id", nullable=True), Field("selected_genres", "list", high=3), Field("eligible_pool_count", "number", 0, whole=True),
        Field("reroll_index", "number", 0, whole=True), Field("finalist_appids", "list", high=32, item="number", optional=True),
    ],
    strict=False,
    rules=[
        ("draw:collection_with_filters", lambda v: _of_collection(v) & ((_chosen(v) > 0) | (F.size(v["selected_genres"]) > 0))),
        ("draw:partial_choice", lambda v: ~_of_collection(v) & ~_chosen(v).isin(0, 3)),
        ("draw:quick_with_genres", lambda v: ~_of_collection(v) & (_chosen(v) == 0) & (F.size(v["selected_genres"]) > 0)),
    ],
)

COLLECTION = Schema(
    [Field("name", low=1, high=90), Field("description", high=280, default=""), Field("kind", choices=("custom", "smart"), default="custom"), Field("preset", choices=PRESET_NAMES, optional=True, path="rules.preset")],
    strict=False,
    rules=[("preset:required", lambda v: (v["kind"] == "smart") & v["preset"].isNull())],
)
