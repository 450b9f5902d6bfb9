"""Text, hash and pattern expressions. All are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of personal data. The first three are the short set.
PII = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"\b(?:\d[ -]?){12,19}\b",
    "phone": r"\b(?:\+?1[ -.]?)?(?:\(?\d{3}\)?[ -.]?)\d{3}[ -.]\d{4}\b",
}
PRIVATE_NUMBER = r"\b(?:\d[ -]?){9,}\b"
# Words of internal systems that a customer must not read.
INTERNAL_LANGUAGE = {
    "synthetic": r"(?i)\bsynthetic\b",
    "demo": r"(?i)\bdemo(?:nstration)?\b",
    "mock": r"(?i)\bmock\b",
    "test": r"(?i)\btest(?:ing| data)?\b",
    "backend": r"(?i)\bback[- ]?end\b",
    "model": r"(?i)\b(?:language )?model\b|\b9b\b",
    "router": r"(?i)\b(?:classifier|router)\b",
    "compute": r"(?i)\b(?:gpu|cpu|cuda|zerogpu)\b",
    "tool": r"(?i)\btool(?: call| result|ing|s)?\b",
}
FORBIDDEN_TERMS = ("demo", "synthetic", "mock", "test", "backend", "gpu", "router", "tool call")
# Requests for credentials, and what before them in the clause forbids them.
CREDENTIAL = r"(?:account number|customer id|password|pin|social security(?: number)?|ssn|security code|one[- ]time verification code|otp)"
CREDENTIAL_REQUEST = (
    rf"\b(?:share|provide|enter|send|give|tell)\s+(?:(?:me|us)\s+)?(?:(?:your|the|a|an)\s+)?{CREDENTIAL}\b"
    rf"|\b(?:i|we)\s+(?:need|require)\s+your\s+{CREDENTIAL}\b"
    rf"|\b(?:what is|what's|may i have|can i have)\s+your\s+{CREDENTIAL}\b"
)
PROHIBITION = r"(?:\bdo not|\bdon't|\bnever|\bshould not|\bshouldn't|\bmust not|\bmustn't|\bavoid)(?:\s+[a-z]+){0,6}\s*"
PRIVATE_VERB = r"\b(?:provide|send|enter|share|tell me|confirm)\b"
PRIVATE_NOUN = r"\b(?:password|pin|account number|customer id|private id)\b"
# Words of a banking fact that a rewritten text must keep.
FACT_WORDS = r"\b(?:frozen|active|closed|open|pending|completed|cancelled|canceled|failed|checking|savings|credit|debit|replacement|dispute|transfer|transaction)\b"
# How a policy is cited, what counts as a quantity, number words, words that lean on what was said before.
CITATION = r"(?i)\[Policy:\s*([^\]]+?)\s*\]"
QUANTITY = r"(?<![\w.])\$?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?![\w.])"
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
CONTEXT_WORDS = ("again", "else", "it", "next", "that", "them", "then", "there", "these", "they", "this", "those")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    Whatever a lambda mentions is computed for every item of its array unless it is an
    argument of a lambda itself, so a costly value is bound as the item of an array of one.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case; all but letters and digits become single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalize_ascii(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def fold_spaces(text: Column) -> Column:
    """Case folded as far as lower case and sharp s go, white space collapsed."""
    return F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"\s+", " "))


def transcript_key(text: Column) -> Column:
    return normalize_ascii(fold_spaces(text))


def words(text: Column) -> Column:
    """Words of the normalized text; none for a text without any."""
    return let(normalize(text), lambda plain: F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " ")))


def word_ngrams(tokens: Column, n: int) -> Column:
    """The set of n-word sequences; empty where there are fewer words."""

    def grams(w: Column) -> Column:
        spans = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(spans)).otherwise(F.array().cast("array<string>"))

    return let(tokens, grams)


def char_trigrams(text: Column) -> Column:
    """The set of character trigrams of the text with two spaces before and after it."""
    padded = F.concat(F.lit("  "), text, F.lit("  "))
    return let(padded, lambda p: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(p) - 2), lambda i: F.substr(p, i, F.lit(3)))))


def trigram_codes(text: Column) -> Column:
    """:func:`char_trigrams` as numbers: three code points of 21 bits each; the work grows with the length alone."""
    points = F.transform(F.filter(F.split(F.concat(F.lit("  "), text, F.lit("  ")), ""), lambda c: c != ""), lambda c: F.ascii(c).cast("bigint"))
    packed = lambda p: F.transform(F.slice(p, F.lit(3), F.size(p)), lambda c, i: F.shiftleft(F.get(p, i), 42).bitwiseOR(F.shiftleft(F.get(p, i + 1), 21)).bitwiseOR(c))
    return F.array_distinct(let(points, packed))


def stable_rank(*parts: Column) -> Column:
    """Hex SHA-256 of the parts with NUL between; a null part counts as empty."""
    return F.sha2(F.concat_ws("\0", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def stable_int(text: Column) -> Column:
    """The first 12 hex digits of the SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 12), 16, 10).cast("bigint")


def call_id(raw: Column, index: Column, name: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", raw, index.cast("string"), name), 256), 1, 16)


def last_four(seed: Column, salt: Column) -> Column:
    return (F.lit(1000) + F.pmod(seed + salt * 997, F.lit(9000))).cast("string")


def money(cents: Column, currency: Column) -> Column:
    """Such as ``-USD 1,234.50``; a dash for none."""
    amount = F.concat(F.when(cents < 0, "-").otherwise(""), currency, F.lit(" "), F.format_number(F.abs(cents).cast("decimal(20,0)") / 100, 2))
    return F.coalesce(amount, F.lit("—"))


def moment(value: Column) -> Column:
    """ISO timestamps to the minute in UTC; other texts as they are, a dash for none."""
    parsed = F.try_to_timestamp(value)
    return F.coalesce(F.date_format(parsed, "yyyy-MM-dd HH:mm' UTC'"), F.nullif(value, F.lit("")), F.lit("—"))


def pii_flags(text: Column, kinds: tuple[str, ...] = tuple(PII)) -> dict[str, Column]:
    return {k: F.coalesce(text.rlike(PII[k]), F.lit(False)) for k in kinds}


def internal_labels(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(k)) for k, p in INTERNAL_LANGUAGE.items())))


def forbidden_terms(text: Column) -> Column:
    return let(normalize_ascii(text), lambda plain: F.filter(F.array(*map(F.lit, FORBIDDEN_TERMS)), lambda t: F.contains(plain, t)))


def requests_credentials(text: Column) -> Column:
    """Whether some clause asks for a credential and nothing before it in the clause forbids that.

    A prohibition covers a request when at most six words are between them.
    """
    clauses = F.split(F.lower(text), r"[.!?;\n]")
    bare = F.transform(clauses, lambda c: F.regexp_replace(c, rf"{PROHIBITION}(?:{CREDENTIAL_REQUEST})", " "))
    return F.coalesce(F.exists(bare, lambda c: c.rlike(CREDENTIAL_REQUEST)), F.lit(False))


def requests_private_data(text: Column) -> Column:
    low = F.lower(text)
    return low.rlike(PRIVATE_VERB) & low.rlike(PRIVATE_NOUN)


def fact_literals(text: Column) -> Column:
    """Numbers of two or more digits and status words, in lower case."""
    found = F.concat(F.regexp_extract_all(text, F.lit(r"\d{2,}"), F.lit(0)), F.regexp_extract_all(F.lower(text), F.lit(FACT_WORDS), F.lit(0)))
    return F.array_sort(F.array_distinct(found))


def lost_facts(before: Column, after: Column) -> Column:
    return let(F.lower(after), lambda low: F.filter(fact_literals(before), lambda x: ~F.contains(low, x)))


def quantities(text: Column) -> Column:
    """Distinct quantities: numbers without separators and trailing zeros, number words as numbers."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(QUANTITY), F.lit(0)), lambda q: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.replace(q, F.lit(","), F.lit("")), r"(\.\d*?)0+(%?)$", "$1$2"), r"\.(%?)$", "$1"), r"^(\$?)0+(?=\d)", "$1"))
    values = F.create_map(*(x for k, v in NUMBER_WORDS.items() for x in (F.lit(k), F.lit(str(v)))))
    spelled = F.transform(F.regexp_extract_all(F.lower(text), F.lit(rf"\b(?:{'|'.join(NUMBER_WORDS)})\b"), F.lit(0)), lambda w: values[w])
    return F.array_sort(F.array_distinct(F.concat(numbers, spelled)))


def citations(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))))


def salvage_json(text: Column) -> Column:
    """The JSON object in a model's answer: fences off, else from the first brace to the last."""
    bare = F.trim(F.regexp_replace(F.trim(text), r"(?s)\A```(?:json)?|```\z", ""))
    return F.when(F.try_parse_json(bare).isNotNull(), bare).otherwise(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))


def one_line(text: Column) -> Column:
    return F.array_join(F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != ""), " ")


def fact_forms(value: Column) -> Column:
    """The forms in which a fact may be written: as is, normalized, without commas, without the point."""
    return F.array_distinct(F.array(value, normalize_ascii(value), F.replace(value, F.lit(","), F.lit("")), F.replace(F.replace(value, F.lit(","), F.lit("")), F.lit("."), F.lit(""))))


def is_contextual(text: Column) -> Column:
    return F.arrays_overlap(words(text), F.array(*map(F.lit, CONTEXT_WORDS)))


def is_revision(text: Column) -> Column:
    return text.rlike(r"\A[0-9a-f]{40}\z")


def is_digest(text: Column) -> Column:
    return text.rlike(r"\A(?:sha256:)?[0-9a-f]{64}\z")
