"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Everything is a column expression on one row: no shuffle and no Python. A pattern's matches come from ``regexp_extract_all``
and the texts between them from ``split`` by the same pattern, so the running lengths of both give each match's place in code
points. Rows without a telling character or digit skip the work.

The patterns are written so that they never go back over what they have read: a run is entered at its first character or
where the last match ended (``\\G``), and repeats are possessive. They find what the plain patterns in the docstrings find,
in time that grows with the text and without recursion, however long a run is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glosswork.llm.common import joined_spans, let, prefix_sums, text_of

_BYTE = "0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9][0-9]?)?"
_SPANS = "array<struct<start:bigint,ord:int,end:bigint,kind:string,score:double>>"
#: Characters before and after a match in which context words count.
CONTEXT = 48


@dataclass(frozen=True)
class Kind:
    """A sort of personal data. A match's score is ``prior``, plus ``bonus`` if a context word is near; it is kept from
    ``threshold`` on. ``hint`` is a pattern that every text with a match has."""

    name: str
    pattern: str
    hint: str
    prior: float = 1.0
    context: str = ""
    bonus: float = 0.4


#: The patterns are the contract's, with the same matches.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]"),
)
ADDED = (
    # only the first four characters are read over; the group has all that may follow, and _number_end says how much does
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11,30}+[A-Za-z0-9]?+))",
         "[A-Z]{2}[0-9]{2}", 0.9, "iban|account|bank|konto|cuenta|compte"),
    Kind("national_id", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.3,
         "ssn|social|security|national|identity|id"),
    Kind("secret", r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}(?![0-9A-Z])|[0-9a-f]{16,64}(?![A-Za-z0-9]))", "[0-9a-fA-Z]{16}", 0.3,
         "password|passwd|secret|token|api[_ -]?key|akia"),
)
THRESHOLD = 0.5
#: Fixed value: characters of an account number by its country code. Of other countries any number of 15 to 34 counts.
_LENGTHS = {code: size for size, codes in {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "PT ST", 26: "IS TR",
    27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
}.items() for code in codes.split()}


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """True if the digits, every second one from the right doubled, sum to a multiple of ten."""
    size = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda sum_, i: sum_ + let(
        F.substring(digits, i, F.lit(1)).cast("int") * (1 + (size - i) % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return total % 10 == 0


def _mod97(match: Column) -> Column:
    """The ISO 7064 check of an account number: moved around and read as digits, it leaves 1 when divided by 97."""
    def step(rest: Column, char: Column) -> Column:
        code = F.ascii(char)
        return F.when(code >= 65, (rest * 100 + code - 55) % 97).otherwise((rest * 10 + code - 48) % 97)

    return let(F.replace(match, F.lit(" "), F.lit("")), lambda bare: F.aggregate(
        F.filter(F.split(F.concat(F.substr(bare, F.lit(5)), F.substr(bare, F.lit(1), F.lit(4))), ""), lambda c: c != ""),
        F.lit(0), step)) == 1


def _number_end(head: Column, tail: Column) -> Column:
    """How many characters of ``tail`` belong to the account number that starts with ``head``: those of the longest part that
    ends with its word, has a length that the country allows and passes the check; none if there is no such part."""
    known = F.create_map(*[F.lit(x) for pair in _LENGTHS.items() for x in pair])
    size = F.try_element_at(known, F.left(head, F.lit(2)))

    def fits(end: Column) -> Column:
        number = F.concat(head, F.substr(tail, F.lit(1), end))
        bare = F.length(F.replace(number, F.lit(" "), F.lit("")))
        return (F.substr(tail, end, F.lit(1)) != " ") & ~F.substr(tail, end + 1, F.lit(1)).rlike("[A-Za-z0-9]") & bare.between(
            15, 34) & (bare == F.coalesce(size, bare)) & _mod97(number)

    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.char_length(tail)), fits)), F.lit(0))


def _apart(spans: Column) -> Column:
    """The spans that don't begin inside an earlier one that stays."""
    return F.aggregate(spans, F.array().cast(_SPANS), lambda done, s: F.when(
        (F.size(done) > 0) & (s["start"] < F.try_element_at(done, F.lit(-1))["end"]), done).otherwise(
            F.concat(done, F.array(s).cast(_SPANS))))


def _valid(kind: Kind, match: Column) -> Column | None:
    if kind.name == "ip":
        return match.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$")
    if kind.name == "card":
        return let(_digits(match), lambda d: F.when(F.length(d).between(14, 19), _luhn(d)).otherwise(False))
    if kind.name == "phone":
        return F.length(_digits(match)).between(10, 15)
    if kind.name == "secret":  # a hexadecimal word has both letters and digits; a number alone is none
        return match.rlike("[0-9]") & match.rlike("[A-Za-z]")
    return None


def _found(kind: Kind, order: int, text: Column) -> Column:
    """The kind's valid spans, in order: an array of (start, ord, end, kind, score)."""
    pattern = F.lit(kind.pattern)

    def spans(matches: Column, between: Column, more: Column | None = None) -> Column:
        # start of match i: the lengths of the i + 1 texts before it and of the i matches before it
        steps = F.zip_with(between, matches, lambda b, m: F.char_length(b) + F.coalesce(F.char_length(m), F.lit(0)))
        return let(prefix_sums(F.transform(steps, lambda x: x.cast("long"))), lambda before: F.filter(
            F.transform(matches, lambda m, i: span(m, i, before, between) if more is None else let(
                _number_end(m, more[i]), lambda n: span(m, i, before, between, n))), lambda s: s["score"] >= THRESHOLD))

    def span(match: Column, i: Column, before: Column, between: Column, longer: Column | None = None) -> Column:
        start = before[i] + F.char_length(between[i])
        after = between[i + 1] if longer is None else F.substr(between[i + 1], longer + 1)
        score = F.lit(kind.prior)
        if kind.context:
            near = F.lower(F.concat(F.right(between[i], F.lit(CONTEXT)), F.lit(" "), F.left(match, F.lit(4)), F.lit(" "),
                                    F.left(after, F.lit(CONTEXT))))
            score = F.when(near.rlike(f"(?<![a-z])(?:{kind.context})(?![a-z])"), kind.prior + kind.bonus).otherwise(score)
        valid = _valid(kind, match) if longer is None else longer > 0
        if valid is not None:
            score = F.when(valid, score).otherwise(0.0)
        return F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + F.char_length(match) + (
            F.lit(0) if longer is None else longer)).alias("end"),
                        F.lit(kind.name).alias("kind"), score.cast("double").alias("score"))

    none = F.array().cast(_SPANS)
    some = let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: let(F.split(text, kind.pattern, -1), lambda b: (
        spans(m, b) if kind.name != "iban" else let(F.regexp_extract_all(text, pattern, F.lit(1)), lambda t: spans(m, b, t)))))
    return F.when(text.rlike(kind.hint), some if kind.name != "iban" else _apart(some)).otherwise(none)


def with_spans(docs: DataFrame, text_col: str = "text", name: str = "pii") -> DataFrame:
    """Add an array of (start, ord, end, kind, score): the personal data in each whole text, by start, then kind.

    Places are code points, the end exclusive. Matches of one kind don't overlap; those of different kinds may. The base
    kinds are email, ip (parts at most 255), card (14 to 19 digits that pass Luhn) and phone (10 to 15 digits). The method
    adds iban (confirmed by mod-97), national_id and secret (only with a context word near). A null or empty text has none.
    A column of that name is replaced, others stay, also those named like a field of a span; repeated rows stay; an empty table gives none.
    """
    text = text_of(text_col)
    kinds = (*BASE, *ADDED)
    found = F.concat(*[_found(kind, i, text) for i, kind in enumerate(kinds)])
    return docs.withColumn(name, F.when(text == "", F.array().cast(
        _SPANS)).otherwise(F.sort_array(found)))


def pii_digest(docs: DataFrame) -> DataFrame:
    """Per document the count of each base kind, the hash of the base spans and all spans."""
    base = [kind.name for kind in BASE]
    found = with_spans(docs.select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined_spans(F.filter("pii", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        joined_spans(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda s: F.format_string("%.1f", s["score"])), ",").alias("scores"))


def redact(docs: DataFrame, text_col: str = "text", spans: str = "pii") -> DataFrame:
    """The texts with each span replaced by its kind in brackets; spans that overlap become one, named by the first.

    A null text stays null, and so does a text without spans."""
    text = F.col(text_col)

    def merge(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"], F.greatest(last["end"], span["end"]), last["kind"])
        kind = "array<struct<start:bigint,end:bigint,kind:string>>"
        return F.when((F.size(done) > 0) & (span["start"] < F.try_element_at(done, F.lit(-1))["end"]), F.concat(
            F.slice(done, F.lit(1), F.size(done) - 1), F.array(wider).cast(kind))).otherwise(F.concat(
                done, F.array(F.struct(span["start"], span["end"], span["kind"])).cast(kind)))

    merged = F.aggregate(spans, F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>"), merge)

    def rebuilt(cuts: Column) -> Column:
        parts = F.transform(cuts, lambda c, i: F.concat(
            let(F.when(i > 0, F.try_element_at(cuts, i)["end"]).otherwise(F.lit(0).cast("long")), lambda at: F.substr(
                text, (at + 1).cast("int"), (c["start"] - at).cast("int"))),
            F.lit("["), F.upper(c["kind"]), F.lit("]")))
        return F.concat(F.array_join(parts, ""), F.substr(text, (F.element_at(cuts, -1)["end"] + 1).cast("int")))

    clean = F.when(F.size(spans) > 0, let(merged, rebuilt)).otherwise(text)
    return docs.withColumn(text_col, clean)
