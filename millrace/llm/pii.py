"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust a score.

Everything is column expressions inside one row; there is no shuffle. Spans are code-point offsets, end exclusive. The base
kinds (email, ip, card, phone) are the leftmost non-overlapping matches of their pattern that pass their validator; a failing
match is dropped and not retried; context moves their scores only. The method's own kinds (iban, secret) stay only if their score reaches
``MIN_SCORE``, which words of doubt near them prevent unless words of their own kind stand there too.

Defined results: a null or empty text has no spans; very long texts are scanned whole (positions are prefix sums: n log n in
the matches of one kind in one text); repeated rows give repeated results; other columns of the
input are kept, and a column named ``spans`` is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.text import let, prefix_sums

CONTEXT = 40
MIN_SCORE = 0.5

# The possessive forms and look-behinds match what the plain patterns match, in linear time and without recursion:
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+     ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+ with 13 digits or more          phone \+[0-9][\x20().0-9-]+[0-9]
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9]){12}(?:[\x20-]?[0-9])*+"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_IBAN = r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b"
_SECRET = r"(?i)\b(?:token|secret|password|passwd|api[_-]?key)\b[\x20\t]*[=:][\x20\t]*[\x22\x27]?[A-Za-z0-9+/_-]{16,}"
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])?"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    one_by_one = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return F.aggregate(F.transform(one_by_one, worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's remainder is 1: four characters moved to the end, letters as 10 to 35."""
    s = F.regexp_replace(iban, " ", "")
    turned = F.filter(F.split(F.concat(F.substring(s, 5, 40), F.substring(s, 1, 4)), ""), lambda c: c != "")

    def step(a: Column, c: Column) -> Column:
        v = F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.when(v < 10, (a * 10 + v) % 97).otherwise((a * 100 + v) % 97)

    return F.aggregate(turned, F.lit(0), step) == 1


#: kind, pattern, a cheap test that any text with a match passes, validator of a match, score before context, context words.
KINDS = (
    ("email", _EMAIL, lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|schreib|correo"),
    ("ip", _IP, lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"\A{_BYTE}(?:\.{_BYTE}){{3}}\z"), 0.6, "server|host|address|addr|login|ip"),
    ("card", _CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), lambda m: let(_digits(m), lambda d: F.length(d).between(13, 19) & luhn(d)), 0.8, "card|visa|master|credit|pay|kart"),
    ("phone", _PHONE, lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(9, 15), 0.7, "phone|call|tel|mobile|fax"),
    ("iban", _IBAN, lambda t: t.rlike(r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}"), mod97, 0.7, "iban|bank|account|konto|transfer"),
    ("secret", _SECRET, lambda t: t.rlike("(?i)token|secret|passw|api[_-]?key"), lambda m: m.rlike("[0-9]"), 0.7, "key|auth|login|access|secret"),
)
BASE = ("email", "ip", "card", "phone")
#: What a neighbouring word of this kind takes from the score.
DOUBT = "example|sample|dummy|test|version|isbn"
SPAN = "struct<kind:string,start:long,end:long,score:double>"


def _found(text: Column, kind: str, pattern: str, valid, score: float, words: str) -> Column:
    """Spans of one kind in a text that passed the cheap test."""

    def spans(parts: Column, matches: Column) -> Column:
        near = lambda i: F.lower(F.concat(F.right(F.get(parts, i), F.lit(CONTEXT)), F.lit(" "), F.left(F.get(parts, i + 1), F.lit(CONTEXT))))
        # a match ends after all the parts and matches so far
        ends = prefix_sums(F.transform(matches, lambda m, i: (F.length(F.get(parts, i)) + F.length(m)).cast("long")))
        each = let(ends, lambda e: F.transform(matches, lambda m, i: F.struct((F.get(e, i) - F.length(m)).alias("start"), m.alias("m"), near(i).alias("near"))))
        placed = F.filter(each, lambda x: valid(x["m"]))
        helped = lambda near: F.when(near.rlike(words), 0.1).otherwise(0.0) - F.when(near.rlike(DOUBT), 0.3).otherwise(0.0)
        return F.transform(placed, lambda x: F.struct(F.lit(kind).alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"), F.least(F.lit(1.0), F.lit(score) + helped(x["near"])).alias("score")))

    return let(F.split(text, pattern, -1), lambda parts: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda matches: spans(parts, matches)))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: array of (kind, start, end, score), by kind as listed in ``KINDS``, then start."""
    t = F.coalesce(F.col(text), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    kinds = []
    for kind, pattern, may, valid, score, words in KINDS:
        found = F.when(may(t), _found(t, kind, pattern, valid, score, words).cast(f"array<{SPAN}>")).otherwise(none)
        kinds.append(found if kind in BASE else F.filter(found, lambda s: s["score"] >= MIN_SCORE))
    return docs.withColumn("spans", F.concat(*kinds))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
