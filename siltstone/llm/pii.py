"""Personal data: regular expressions propose spans, checksums confirm them, context adjusts the score.

Everything is a Spark expression. Each pattern is matched twice over a text, once for the matches
and once for what stands between them, and running lengths give each match its offsets in code
points. The base kinds (email, ip, card, phone) are decided by pattern and checksum alone; the added
ones (iban, local phone numbers) need a checksum or a context word, and never overlap a base span.

A null text is empty and has no span; repeated rows each get their row; other columns are ignored.
Patterns are possessive or anchored at the start of a run, so long runs cost linear time and no stack.
Offsets are running sums by runs, overlaps are found by halving and context is read from blocks, so a
text of very many matches costs little more a match than a short one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns that equal the stated ones, written so that Java matches them in linear time.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
LOCAL = r"(?<![A-Za-z0-9+.()-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[\x20./-][0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![A-Za-z0-9.-])"
KINDS = ("email", "ip", "card", "phone", "iban", "local")
#: Score of a proposal by kind, what a nearby context word adds, and the least score of an added span.
SCORES = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "local": 0.3}
CONTEXT_BONUS, ACCEPT = 0.2, 0.5
CONTEXT_CHARS = 40
#: Characters of the blocks from which context is read.
BLOCK = 256
CONTEXT = {
    "email": r"mail|contact|correo|courriel",
    "ip": r"\bip\b|host|server|address",
    "card": r"card|visa|credit|karte|carte|tarjeta",
    "phone": r"phone|call|\btel|mobile|fax|fono|anruf",
    "iban": r"iban|bank|account|konto|compte|cuenta",
    "local": r"phone|call|\btel|mobile|fax|fono|anruf",
}


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """True if a string of digits passes the Luhn checksum."""

    def add(total: Column, at: Column) -> Column:
        digit = F.substring(digits, -at, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(at % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def mod97(iban: Column) -> Column:
    """True if an account number without spaces leaves 1 modulo 97, letters counting 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def add(rest: Column, char: Column) -> Column:
        value = F.when(char.rlike("[0-9]"), char.cast("int")).otherwise(F.ascii(char) - 55)
        return F.when(value > 9, (rest * 100 + value) % 97).otherwise((rest * 10 + value) % 97)

    return F.aggregate(F.split(turned, ""), F.lit(0), lambda rest, char: F.when(char == "", rest).otherwise(add(rest, char))) == 1


def _confirmed(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        small = lambda part: F.length(F.ltrim(part, F.lit("0"))) <= 3
        return F.forall(F.split(match, r"\."), lambda part: F.when(small(part), part.cast("decimal(38,0)") <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    if kind == "iban":
        return mod97(F.regexp_replace(match, " ", ""))
    if kind == "local":
        return F.length(digits).between(7, 12)
    return F.lit(True)


SPAN = "array<struct<start:int,rank:int,end:int,match:string>>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _sums(sizes: Column) -> Column:
    """Running sums of an array; each step copies the sums so far, so only for short arrays."""
    start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        return F.struct((state["total"] + size).alias("total"), F.concat(state["out"], F.array(state["total"] + size)).alias("out"))

    return F.aggregate(sizes, start, step, lambda state: state["out"])


def _running(sizes: Column) -> Column:
    """Running sums of an array that is not empty, by runs of about the square root of its length."""

    def by_runs(sizes: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(sizes))).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / width).cast("int")), lambda k: _sums(F.slice(sizes, k * width + 1, width)))
        return _let(runs, after_runs)

    def after_runs(runs: Column) -> Column:
        before = _sums(F.transform(runs, lambda run: F.element_at(run, -1)))
        return _let(before, lambda sums: F.flatten(F.transform(runs, lambda run, k: _let(F.coalesce(F.get(sums, k - 1), F.lit(0)), lambda base: F.transform(run, lambda x: x + base)))))

    return _let(sizes, by_runs)


def _spans(text: Column, kind: str, pattern: str, matches: str) -> Column:
    """Confirmed matches as (start, rank of kind, end, match), from the matches and the pieces between them."""
    pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
    ends = _running(F.zip_with(matches, pieces, lambda match, piece: F.length(match) + F.length(piece)))

    def span(match: Column, end: Column) -> Column:
        return F.struct((end - F.length(match)).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), end.alias("end"), match.alias("match"))

    kept = F.filter(F.zip_with(matches, ends, span), lambda s: _confirmed(kind, s["match"]))
    return F.when(F.size(matches) > 0, kept).otherwise(F.array().cast(SPAN))


def _meets(kind: str, span: Column) -> Column:
    """True if a span shares a character with one of a kind, whose spans are in order and apart: the first
    that ends behind the span's start is found by halving."""
    half = lambda s: F.shiftright(s["low"] + s["high"], 1)
    start = F.struct(F.lit(0).alias("low"), F.size(kind).alias("high"))

    def step(state: Column, _: Column) -> Column:
        behind = F.get(F.col(kind), half(state))["end"] > span["start"]
        low = F.when(behind | (state["low"] >= state["high"]), state["low"]).otherwise(half(state) + 1)
        return F.struct(low.alias("low"), F.when(behind, half(state)).otherwise(state["high"]).alias("high"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(kind) + 1)).cast("int"))
    first = F.aggregate(steps, start, step, lambda state: state["low"])
    return F.when(F.size(kind) > 0, F.coalesce(F.get(F.col(kind), first)["start"] < span["end"], F.lit(False))).otherwise(F.lit(False))


def _told(spans: Column) -> Column:
    """`kind:start:end` of sorted spans, joined by commas."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rank"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Spans of personal data in every whole text: base and added ones, with scores.

    Returns doc_id, an array of structs per group of kinds (`base`, `added`: start, rank, end, match)
    and `scores`, which follow `base` then `added`.
    """
    text = F.col("text")
    patterns = dict(zip(KINDS, (EMAIL, IP, CARD, PHONE, IBAN, LOCAL)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Cheap tests first: most texts hold no sign at all of most kinds.
    hints = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.contains("+")}
    hints |= {"iban": text.rlike("[A-Z]{2}[0-9]{2}"), "local": text.rlike(r"[0-9]{3}")}
    none = F.array().cast("array<string>")
    rows = rows.select("*", *[F.when(hints[k], F.regexp_extract_all(text, F.lit(p), F.lit(0))).otherwise(none).alias(f"m_{k}") for k, p in patterns.items()])
    rows = rows.select("doc_id", "text", *[_spans(text, k, p, f"m_{k}").alias(k) for k, p in patterns.items()])
    # array_sort orders by start, then by the rank of the kind, then by end.
    rows = rows.withColumn("base", F.array_sort(F.concat("email", "ip", "card", "phone")))

    # Context is read from blocks of the text, as a place in a long text is found from its start only.
    any_span = F.size("base") + F.size("iban") + F.size("local") > 0
    rows = rows.withColumn("blocks", F.when(any_span, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))

    def free(span: Column) -> Column:
        return ~(_meets("email", span) | _meets("ip", span) | _meets("card", span) | _meets("phone", span))

    def score(span: Column) -> Column:
        begin = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
        first, last = F.floor(begin / BLOCK).cast("int"), F.floor((span["end"] + CONTEXT_CHARS) / BLOCK).cast("int")
        around = F.array_join(F.slice("blocks", first + 1, last - first + 1), "")
        near = F.lower(F.substring(around, begin - first * BLOCK + 1, span["end"] - begin + CONTEXT_CHARS))
        return _let(near, lambda near: scored(span, near))

    def scored(span: Column, near: Column) -> Column:
        value = F.lit(0.0)
        for rank, kind in enumerate(KINDS):
            value = F.when(span["rank"] == rank, F.lit(SCORES[kind]) + F.when(near.rlike(CONTEXT[kind]), F.lit(CONTEXT_BONUS)).otherwise(F.lit(0.0))).otherwise(value)
        return F.round(F.least(value, F.lit(1.0)), 3)

    rows = rows.withColumn("added", F.filter(F.array_sort(F.concat("iban", "local")), lambda s: free(s) & (score(s) >= ACCEPT)))
    # A local number inside an account number is part of it.
    rows = rows.withColumn("added", F.filter("added", lambda s: (s["rank"] == KINDS.index("iban")) | ~_meets("iban", s)))
    return rows.withColumn("scores", F.transform(F.concat("base", "added"), score))


def pii_digest(docs: DataFrame) -> DataFrame:
    """One row per document: counts by base kind, the base spans' digest and all spans."""
    found = find_pii(docs)
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(_told(F.col("base")), 256).alias("base_sha256"),
        _told(F.array_sort(F.concat("base", "added"))).alias("spans"), F.array_max("scores").alias("score_max"),
    )
