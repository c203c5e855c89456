"""Personal data by patterns, checksums and context, in SQL functions only.

A pattern proposes spans; a check (digits, ranges, Luhn, modulo 97) confirms them; words
close to a span, before or after it, raise its score, for some kinds from below the
threshold.  Positions count code points.  A pattern's pieces and matches come from one
split and one extraction; they are walked block by block with the position and the last
characters as state, so the cost is the text's length and the power 3/2 of its matches.

The base kinds are email, ip, card and phone, leftmost and not overlapping within a
kind; all of them stay, whatever their score.  The method adds iban (modulo 97), and ssn
and local_phone numbers in context, where they touch no base span.

Defined cases: null text counts as empty (no spans); null doc_ids and repeated
rows are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from surety.llm import shared
from surety.llm.merkle import let

SPAN = "struct<kind:string,start:int,end:int,score:double>"


class Kind(NamedTuple):
    name: str
    #: Possessive and anchored where a run starts or the last match ended, so no text is scanned twice.
    pattern: str
    #: The same without either, as the contract or SQL states it.
    plain: str
    #: A cheap test that any text with a span of this kind passes.
    hint: str
    check: str
    #: Hundredths of the score, without and with a word of its context close to the span.
    score: int
    raised: int
    context: tuple[str, ...]
    #: Letters that may not stand right before and right after a span.
    not_before: str = ""
    not_after: str = ""


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    """Whether the digits of ``m`` pass the Luhn check."""
    figures = F.split(F.reverse(digits(m)), "")
    doubled = F.transform(figures, lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(m: Column) -> Column:
    """Whether an account number, its first four characters put last, is 1 modulo 97."""
    bare = F.regexp_replace(m, " ", "")
    turned = F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), "")

    def step(a, x):
        value = F.when(x.between("0", "9"), x.cast("int")).otherwise(F.ascii(x) - 55)
        return F.when(value > 9, (a * 100 + value) % 97).otherwise((a * 10 + value) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


def _in_range(m: Column) -> Column:
    return F.forall(F.split(m, r"\."), lambda x: F.length(F.regexp_replace(x, "^0+", "")).cast("int") <= 3) & F.forall(F.split(m, r"\."), lambda x: F.right(x, F.lit(3)).cast("int") <= 255)


def _long_enough(least: int, most: int):
    return lambda m: F.length(digits(m)).between(least, most)


CHECKS = {
    "none": lambda m: F.lit(True),
    "parts": _in_range,
    "luhn": lambda m: _long_enough(16, 19)(m) & luhn(m),
    "digits": _long_enough(8, 15),
    "mod97": lambda m: F.length(F.regexp_replace(m, " ", "")).between(15, 34) & mod97(m),
}

BASE = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "@", "none", 90, 95, ("mail", "e-mail", "email", "contact", "kontakt", "correo", "courriel")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "parts", 70, 90, ("ip", "host", "server", "address", "adresse")),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", r"[0-9](?:[ -]?[0-9])+", r"[0-9](?:[ -]?[0-9]){15}", "luhn", 85, 98, ("card", "visa", "mastercard", "credit", "kreditkarte", "karte", "tarjeta", "carte")),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", "digits", 75, 90, ("tel", "telefon", "phone", "call", "mobile", "fax", "handy")),
)
_LOCAL = r"(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}"
_IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_SSN = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
ADDED = (
    Kind("iban", _IBAN, _IBAN, r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", "mod97", 90, 98, ("iban", "account", "konto", "cuenta", "compte"), "A-Za-z0-9", "A-Za-z0-9"),
    Kind("ssn", _SSN, _SSN, _SSN, "none", 30, 90, ("ssn", "social security", "sozialversicherung", "seguridad social"), "0-9-", "0-9-"),
    Kind("local_phone", _LOCAL, _LOCAL, r"[0-9]{3}[ .)-]{1,2}[0-9]{3}[ .-][0-9]{4}", "none", 40, 80, ("tel", "telefon", "phone", "call", "mobile", "fax"), "0-9+.-", "0-9-"),
)
#: Hundredths below which spans of the added kinds are dropped; characters before and after a span that count as context.
THRESHOLD, CONTEXT_CHARS = 60, 40


def context_of(kind: Kind) -> str:
    """A word of the kind's context, between letters of no word."""
    return rf"(?i)(?:^|[^A-Za-z0-9])(?:{'|'.join(kind.context)})(?:[^A-Za-z0-9]|\z)"


def fold(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """All that ``step(state, item) -> (state, array<kind>)`` gives, item after item.

    Blocks of about the root of the items' number keep the copies of what was given so far small.
    """

    def inner(before: Column, block: Column) -> Column:
        def one(a, x):
            after, given = step(a["s"], x)
            return F.struct(after.alias("s"), F.concat(a["out"], given).alias("out"))

        return F.aggregate(block, F.struct(before.alias("s"), F.array().cast(f"array<{kind}>").alias("out")), one)

    def outer(a, block):
        return let(inner(a["s"], block), lambda r: F.struct(r["s"].alias("s"), F.concat(a["out"], F.array(r["out"])).alias("out")))

    def of(blocks: Column) -> Column:
        return F.flatten(F.aggregate(blocks, F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("out")), outer, lambda a: a["out"]))

    size = let(items, lambda i: F.struct(i.alias("items"), F.greatest(F.ceil(F.sqrt(F.size(i))), F.lit(1)).cast("int").alias("n")))
    blocks = let(size, lambda z: F.transform(F.sequence(F.lit(0), F.floor(F.size(z["items"]) / z["n"]).cast("int")), lambda b: F.slice(z["items"], b * z["n"] + 1, z["n"])))
    return of(blocks)


def spans_of(text: Column, kind: Kind) -> Column:
    """Confirmed spans of one kind."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    after = F.regexp_extract_all(text, F.lit(rf"{kind.pattern}(?=((?s:.{{0,{CONTEXT_CHARS}}})))"), F.lit(1))
    found = F.zip_with(found, after, lambda m, a: F.struct(m.alias("match"), a.alias("after")))
    pieces = F.zip_with(F.split(text, kind.pattern, -1), found, lambda g, m: F.struct(g.alias("gap"), m["match"].alias("match"), m["after"].alias("after")))
    none = F.array().cast(f"array<{SPAN}>")
    last = lambda x: F.right(x, F.lit(CONTEXT_CHARS))

    def step(state, x):
        start = (state["at"] + F.length(x["gap"])).cast("int")
        end = (start + F.coalesce(F.length(x["match"]), F.lit(0))).cast("int")
        before = last(F.concat(state["before"], x["gap"]))
        near = before.rlike(context_of(kind)) | x["after"].rlike(context_of(kind))
        score = F.when(near, kind.raised).otherwise(kind.score)
        good = x["match"].isNotNull() & CHECKS[kind.check](x["match"])
        if kind.not_before:
            good &= ~before.rlike(rf"[{kind.not_before}]\z") & ~x["after"].rlike(f"^[{kind.not_after}]")
        if kind in ADDED:
            good &= score >= THRESHOLD
        one = F.array(F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), end.alias("end"), (score / 100.0).cast("double").alias("score")))
        state = F.struct(end.alias("at"), last(F.concat(before, F.coalesce(x["match"], F.lit("")))).alias("before"))
        return state, F.when(good, one).otherwise(none)

    all_ = fold(pieces, F.struct(F.lit(0).alias("at"), F.lit("").alias("before")), SPAN, step)
    hint = F.instr(text, kind.hint) > 0 if len(kind.hint) == 1 else text.rlike(kind.hint)
    return F.when(hint, all_).otherwise(none)


def find(docs: DataFrame, base: str = "base", added: str = "added", column: str = "text") -> DataFrame:
    """Add the columns ``base`` and ``added``, arrays of spans, to ``docs`` with texts in ``column``."""
    text = F.coalesce(F.col(column), F.lit(""))
    docs = docs.withColumn(base, F.concat(*[spans_of(text, k) for k in BASE]))
    clear = lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return docs.withColumn(added, F.filter(F.concat(*[spans_of(text, k) for k in ADDED]), clear))


def written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts by base kind, SHA-256 of the base spans, all spans as text, and their scores in hundredths likewise."""
    found = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", "base", "added")

    def count(kind: Kind) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind.name)).cast("long").alias(f"n_{kind.name}")

    every = F.concat("base", "added")
    scores = F.array_join(F.transform(every, lambda s: F.round(s["score"] * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *map(count, BASE), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(every).alias("spans"), scores.alias("scores"))


def redact(docs: DataFrame) -> DataFrame:
    """Put ``<KIND>`` in place of each span of ``text`` (of overlapping ones, the first); columns stay.

    The spans are dealt to blocks of about the root of their number; a block's part of the
    text is cut out once, so that no position is counted from the text's beginning again.
    """
    names, base, added = docs.columns, shared.fresh(docs, "base"), shared.fresh(docs, "added")
    found = find(docs.select("*"), base, added)
    spans = F.array_sort(F.transform(F.concat(base, added), lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")

    def first(state, s):
        fits = s["start"] >= state["at"]
        return F.struct(F.when(fits, -s["end"]).otherwise(state["at"]).cast("int").alias("at")), F.when(fits, F.array(s)).otherwise(none)

    kept = fold(spans, F.struct(F.lit(0).alias("at")), "struct<start:int,end:int,kind:string>", first)
    text = F.col("text")

    def part(block: Column, upto: Column) -> Column:
        """The text from a block's first span up to the next block's, marks in place of the spans."""
        origin = block[0]["start"]
        inside = F.substr(text, origin + 1, upto - origin)
        marked = F.transform(block, lambda s, i: F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"), F.substr(inside, -s["end"] - origin + 1, F.coalesce(F.get(block, i + 1)["start"], upto) + s["end"])))
        return F.array_join(marked, "")

    def put(k: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(k))), F.lit(1)).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(k) - 1) / n).cast("int")), lambda b: F.struct(F.slice(k, b * n + 1, n).alias("block"), F.coalesce(F.get(k, (b + 1) * n)["start"], F.char_length(text)).alias("upto")))
        return F.concat(F.substr(text, F.lit(1), k[0]["start"]), F.array_join(F.transform(blocks, lambda x: let(x, lambda y: part(y["block"], y["upto"]))), ""))

    clean = F.when(F.size(base) + F.size(added) > 0, let(kept, put)).otherwise(text)
    return found.withColumn("text", clean).select(*names)
