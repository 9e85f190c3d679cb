"""Personal-data spans with DataFrame functions only.

Regular expressions propose spans, checksum validators (range of octets, Luhn,
mod-97) confirm them, and context words shortly before or after a span adjust its score.

Positions come from pairing the gaps ``split`` leaves with the matches
``regexp_extract_all`` returns.  The patterns are possessive and start only
at the beginning of a run (or where the last match ended), so they take linear
time and constant stack on any text and still give the leftmost non-overlapping
matches of the plain patterns they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: kind: (characters the text must hold, pattern), in the order of the result.
PATTERNS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    # whole chains of digits and single separators, 13 to 19 digits long
    "card": ("", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){12,18}+(?![\x20-]?[0-9])"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
    "iban": ("", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?+[A-Z0-9]{4}){2,7}+(?:\x20?+[A-Z0-9]{1,3}+)?+(?![A-Za-z0-9])"),
}
BASE_KINDS = ("email", "ip", "card", "phone")
#: Words near a span that make it likelier, by kind.
CONTEXT = {
    "email": "mail|contact|write|kontakt|courriel|correo",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|carte|tarjeta",
    "phone": "phone|call|tel|mobile|telefon|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
}
#: Score of a confirmed span without and with a context word within WINDOW characters.
SCORES, WINDOW = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9}, 40
BLOCK = 256
NONE = "array<struct<kind:string,start:int,end:int,score:double>>"


def luhn(digits: Column) -> Column:
    """Luhn's checksum over a string of digits."""
    n = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(values, F.lit(0), lambda acc, v: acc + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def mod97(code: Column) -> Column:
    """The mod-97 check of an account number (country and check digits move to the end)."""
    compact = F.regexp_replace(code, " ", "")
    moved = F.concat(F.substring(compact, F.lit(5), F.length(compact)), F.substring(compact, F.lit(1), F.lit(4)))

    def step(acc, ch):
        letter = F.ascii(ch) - 55
        return F.when(F.ascii(ch) < 58, (acc * 10 + F.ascii(ch) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    letters = F.transform(F.sequence(F.lit(1), F.length(moved)), lambda i: F.substring(moved, i, F.lit(1)))
    return F.aggregate(letters, F.lit(0), step) == 1


def _valid(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        return F.when(F.length(F.regexp_replace(match, " ", "")).between(15, 34), mod97(match)).otherwise(False)
    return F.lit(True)


def _located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match, around>> of the matches of a pattern; ``around``: what stands beside the match.

    Running positions are summed inside blocks of BLOCK pieces and then over the blocks, so a text with very
    many matches costs little more than one pass.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    beside = F.transform(gaps, lambda gap: F.struct(F.right(gap, F.lit(WINDOW)).alias("end"), F.left(gap, F.lit(WINDOW)).alias("start")))
    around = F.zip_with(beside, F.slice(beside, 2, F.greatest(F.size(beside) - 1, F.lit(0))), lambda x, y: F.concat(x["end"], F.lit("\n"), F.coalesce(y["start"], F.lit(""))))
    pieces = F.zip_with(gaps, matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")))
    pieces = F.zip_with(pieces, around, lambda x, y: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), y.alias("around")))
    size = lambda x: x["gap"] + F.coalesce(F.length(x["match"]), F.lit(0))
    span = "struct<start:int,end:int,match:string,around:string>"

    def add(acc, x):
        start = acc["at"] + x["gap"]
        end = start + F.length(x["match"])
        found = F.struct(start.alias("start"), end.alias("end"), x["match"].alias("match"), x["around"].alias("around"))
        return F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(x["match"].isNotNull(), F.concat(acc["spans"], F.array(found))).otherwise(acc["spans"]).alias("spans"),
        )

    def block(b):
        part = F.slice(pieces, b * BLOCK + 1, F.lit(BLOCK))
        return F.aggregate(part, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{span}>").alias("spans")), add)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pieces) - 1) / BLOCK).cast("int")), block)
    begins = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
    moved = F.zip_with(
        blocks,
        begins,
        lambda x, begin: F.transform(
            x["spans"],
            lambda s: F.struct((s["start"] + begin).alias("start"), (s["end"] + begin).alias("end"), s["match"].alias("match"), s["around"].alias("around")),
        ),
    )
    return F.flatten(F.filter(moved, lambda x: x.isNotNull()))


def _spans(kind: str, text: Column) -> Column:
    """array<struct<kind, start, end, score>> of the confirmed spans of one kind."""
    needs, pattern = PATTERNS[kind]
    near = lambda x: F.lower(x["around"]).rlike(rf"\b(?:{CONTEXT[kind]})")
    confirmed = F.transform(
        F.filter(_located(text, pattern), lambda x: _valid(kind, x["match"])),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            x["start"].alias("start"),
            x["end"].alias("end"),
            (F.lit(SCORES[kind]) + F.when(near(x), 0.1).otherwise(0.0)).alias("score"),
        ),
    )
    possible = text.contains(needs) if needs else F.lit(True)
    return F.when(possible & text.rlike(pattern), confirmed).otherwise(F.array().cast(NONE))


def find_personal_data(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``pii``: array<struct<kind, start, end, score>> by kind, then start.

    Offsets count code points, the end is exclusive.  A null or empty text has an empty array.
    ``iban`` spans (mod-97) come on top of the four base kinds.  Spans of different kinds may overlap; within a
    kind the leftmost match counts.  Repeated rows are treated alike, texts of any length are whole, an empty table
    stays empty, an input column ``pii`` is replaced.
    """
    text = F.coalesce(df[text_col], F.lit(""))
    digits = text.rlike("[0-9]")
    none = F.array().cast(NONE)
    kinds = [_spans("email", text), *[F.when(digits, _spans(k, text)).otherwise(none) for k in PATTERNS if k != "email"]]
    return df.withColumn("pii", F.concat(*kinds))


def span_list(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
