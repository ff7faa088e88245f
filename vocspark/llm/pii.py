"""Personal data in texts, with SQL functions only.

Per kind, a regular expression proposes spans, leftmost and without overlap; a validator (value
range, number of digits, Luhn, mod 97) confirms them; words near a span add to its score. The
base kinds email, ip, card and phone are kept whatever their score. The further kinds need
one: iban must pass mod 97, and local (a national number of 7 to 12 grouped digits) needs a
context word before it.

Where a span lies follows from splitting a text by the same expression: a match begins after
the pieces and matches before it. Group repetitions are possessive and runs start at their first
character, so that matching takes linear time and no stack on very long texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    reverse = F.reverse(digits)
    places = F.sequence(F.lit(1), F.length(reverse))

    def share(i: Column) -> Column:
        d = F.substring(reverse, i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(places, F.lit(0), lambda total, i: total + share(i)) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces passes ISO 7064 mod 97-10."""
    moved = F.upper(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)))

    def step(rest: Column, c: Column) -> Column:
        code = F.ascii(c)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(F.split(moved, ""), F.lit(0), lambda rest, c: F.when(c == "", rest).otherwise(step(rest, c))) == 1


@dataclass(frozen=True)
class Kind:
    """``base`` kinds keep every valid span; others need ``least`` of score."""

    name: str
    pattern: str
    valid: object
    context: str
    prior: float = 0.6
    base: bool = False
    least: float = 0.75


# The four base expressions, in the form that Java matches without recursion.
_IN_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_IN_LOCAL}]))[{_IN_LOCAL}]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]+"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])"
LOCAL = r"(?<![0-9+.-])(?<![0-9]\x20)\(?[0-9]{2,4}\)?[\x20-][0-9]{3,4}(?:[\x20-][0-9]{2,4})?(?![0-9.-])"

KINDS = (
    Kind("email", EMAIL, lambda v: F.lit(True), "mail|contact|kontakt|correo|courriel|write to", base=True),
    Kind("ip", IP, lambda v: F.forall(F.split(v, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3).cast("int") <= 255)), "ip|host|server|address|adresse|direcci", base=True),
    Kind("card", CARD, lambda v: F.length(_digits(v)).between(13, 19) & luhn(_digits(v)), "card|visa|credit|karte|tarjeta|carte|payment", prior=0.7, base=True),
    Kind("phone", PHONE, lambda v: F.length(_digits(v)).between(9, 15), "phone|call|tel|fax|mobile|handy|anruf", base=True),
    Kind("iban", IBAN, lambda v: mod97(F.replace(v, F.lit(" "), F.lit(""))), "iban|bank|account|konto|cuenta|compte", prior=0.8),
    Kind("local", LOCAL, lambda v: F.length(_digits(v)).between(7, 12), "phone|call|tel|fax|mobile|handy|anruf", prior=0.5, least=0.75),
)


def _spans(text: Column, kind: Kind, window: int) -> Column:
    """array<struct<start, end, value, score>> of the valid spans of one kind."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.split(text, kind.pattern, -1)
    pairs = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(found)), lambda v, p: F.struct(v.alias("value"), p.alias("before")))
    empty = F.expr("struct(0L as at, cast(array() as array<struct<start: bigint, end: bigint, value: string, score: double>>) as spans)")

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + F.length(pair["before"])
        end = start + F.length(pair["value"])
        near = F.lower(F.substring(pair["before"], -window, window))
        score = F.least(F.lit(1.0), kind.prior + F.when(near.rlike(kind.context), F.lit(0.3)).otherwise(F.lit(0.0)))
        keep = kind.valid(pair["value"]) if kind.base else kind.valid(pair["value"]) & (score >= kind.least)
        span = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"), score.alias("score"))
        return F.struct(end.alias("at"), F.when(keep, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return F.aggregate(pairs, empty, add, lambda s: s["spans"])


def find(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text_col: str = "text", out: str = "pii", window: int = 40) -> DataFrame:
    """``docs`` with ``out``: a struct with one array of spans (start, end, value, score) per kind.

    Places are code points from 0, ends exclusive. A null or empty text has none. Texts are read
    whole, rows stay as they are, and a column of the name ``out`` is replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string, score: double>>)")
    sign = {"email": text.contains("@"), "phone": text.contains("+")}
    return docs.withColumn(out, F.struct(*(F.when(sign.get(k.name, text.rlike("[0-9][ .-]?[0-9]")), _spans(text, k, window)).otherwise(none).alias(k.name) for k in kinds)))


def _listed(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))


def report(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """(doc_id, n_<base kind>..., base_sha256, spans, n_further, max_score) for every row of ``docs``."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), kinds).select("doc_id", "pii")
    base = [k for k in kinds if k.base]
    lists = lambda which: F.array_join(F.concat(*(_listed(F.col(f"pii.{k.name}"), k.name) for k in which)), ",")
    scores = F.concat(*(F.transform(F.col(f"pii.{k.name}"), lambda s: s["score"]) for k in kinds))
    return found.select(
        "doc_id",
        *(F.size(f"pii.{k.name}").cast("long").alias(f"n_{k.name}") for k in base),
        F.sha2(lists(base), 256).alias("base_sha256"),
        lists(kinds).alias("spans"),
        *(F.size(f"pii.{k.name}").cast("long").alias(f"n_{k.name}") for k in kinds if not k.base),
        F.array_max(scores).alias("max_score"),
    )
