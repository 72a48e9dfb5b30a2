"""Normalisers, matchers and identifier scans as column expressions; match offsets by one Arrow function."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that say that no answer is known.
ABSTENTIONS = ["i don't know", "i do not know", "i'm not sure", "i am not sure", "i cannot", "unable to", "no information"]
#: Identifier shapes (Java and Python syntax alike) and the confidence of each.
WORD_DIGITS = r"(?:zero|one|two|three|four|five|six|seven|eight|nine)"
OBFUSCATED = [(rf"\b\d{{4,8}}(?:\s+{WORD_DIGITS}){{3,}}", 0.62), (r"\b[X*x]{4,}\s*\d{2,6}\b", 0.58), (r"\b\d{2}[*X]{4,}\d{2}\b", 0.58), (r"\b\d{3,7}\s*(?:ka|wala|\(space\)|-)\s*\d{3,7}\b", 0.52)]
UPI, UPI_SPOKEN = r"\b[a-z0-9][a-z0-9._-]{1,}\s?@\s?[a-z][a-z0-9]{1,}\b", r"\b[a-z][a-z0-9._-]{2,}\s*(?:at the rate|@)\s*(?:ok\w+|ybl|paytm|upi)\b"
IFSC = r"\b[A-Z]{4}[\s.\-]{0,2}0[\s.\-]{0,2}[A-Z0-9]{6}\b"
TWELVE = r"(?<![\d])\d{2,4}(?:[\s.\-]{0,3}\d{2,4}){2,5}(?![\d])"
PAN = r"(?<![A-Z0-9])[A-Z]{3}[\s.\-]{0,2}[A-Z]{2}[\s.\-]{0,2}\d{4}[\s.\-]{0,2}[A-Z](?![A-Z0-9])"
PHONE = r"(?<![\d])(?:\+?91[\s.\-]{0,3})?\d{2,5}(?:[\s.\-]{0,3}\d{2,5}){1,4}(?![\d])"
LEAST_CONFIDENCE = 0.35
SPANS = "array<struct<kind:string,text:string,start:int,end:int,confidence:double>>"
FOUND = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("confidence", pa.float64())]))


def question(text: Column) -> Column:
    """Lower case, everything but letters, digits and underscores as one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", " "), " +", " "))


def answer(text: Column) -> Column:
    """Lower case, ASCII punctuation as spaces, articles dropped, spaces collapsed."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(bare, r"[ \t\n\r]+", "  "), F.lit(" ")), " (a|an|the) ", " "), " +", " "))


def answer_deleted(text: Column) -> Column:
    """As ``answer``, but ASCII punctuation is deleted and articles stay."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", ""), r"[ \t\n\r]+", " "))


def alias_rule(response: Column, aliases: Column) -> Column:
    """Whether an alias is found, and how: short ones as whole words, longer ones anywhere. Both are normalised."""
    words = F.split(response, " ")
    token = F.exists(aliases, lambda a: (F.length(a) < 3) & (F.length(a) > 0) & F.array_contains(words, a))
    part = F.exists(aliases, lambda a: (F.length(a) >= 3) & F.contains(response, a))
    return F.when(F.length(response) == 0, "empty").when(part, "substring").when(token, "token").otherwise("none")


def abstains(text: Column, phrases: list[str] = ABSTENTIONS) -> Column:
    plain = F.regexp_replace(F.lower(F.translate(text, "’", "'")), r"\s+", " ")
    return F.greatest(*[F.contains(plain, F.lit(p)) for p in phrases])


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def seconds(duration: Column) -> Column:
    """``24h``, ``90m``, ``7d`` or ``30s`` in seconds; null for anything else."""
    unit = F.regexp_extract(duration, r"^\d+([smhd])$", 1)
    return F.when(unit != "", F.regexp_extract(duration, r"^(\d+)", 1).cast("long") * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).otherwise(86400))


def script_share(text: Column, script: str) -> Column:
    """Share of a script among the letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.try_divide(F.length(F.regexp_replace(text, rf"[^\p{{Is{script}}}]|[^\p{{L}}]", "")).cast("double"), letters.cast("double"))


def _multiply(a: int, b: int) -> int:
    """In the dihedral group of the pentagon: 0 to 4 turn, 5 to 9 mirror."""
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


#: Fixed value: the permutation of the check; its powers follow.
_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)
_POWERS = [tuple(range(10))]
for _ in range(7):
    _POWERS.append(tuple(_POWERS[-1][_PERMUTATION[i]] for i in range(10)))


def verhoeff_valid(number: Column) -> Column:
    """Whether a string of digits ends in its Verhoeff check digit."""
    product = F.array(*[F.lit(_multiply(a, b)) for a in range(10) for b in range(10)])
    power = F.array(*[F.lit(p[i]) for p in _POWERS for i in range(10)])
    places = F.sequence(F.lit(0), F.length(number) - 1)
    digit = lambda i: F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
    check = F.aggregate(places, F.lit(0), lambda c, i: F.get(product, c * 10 + F.get(power, (i % 8) * 10 + digit(i))))
    return F.when(F.length(number) > 0, check == 0).otherwise(False)


def found(text: Column, pattern: str) -> Column:
    """All matches, upper and lower case alike."""
    return F.regexp_extract_all(text, F.lit("(?i)" + pattern), F.lit(0))


def compact(text: Column) -> Column:
    return F.upper(F.translate(text, " .-", ""))


def pii_score(text: Column) -> Column:
    """The confidence of the surest identifier found, or 0: the largest survives any dropping of overlaps."""
    twelve = F.filter(F.transform(found(text, TWELVE), digits), lambda n: F.length(n) == 12)
    pans = F.transform(found(text, PAN), compact)
    phones = F.filter(F.transform(found(text, PHONE), digits), lambda n: F.length(n).between(10, 13))
    # What a shape can't do without is looked for first: a digit, or the sign of an address.
    digit, sign = text.rlike("[0-9]"), F.contains(text, F.lit("@"))
    numbers = [
        F.when(F.exists(twelve, verhoeff_valid), 0.95).when(F.size(twelve) > 0, 0.55).otherwise(0.0),
        F.when(F.exists(pans, lambda p: F.substring(p, 4, 1).isin(*"PCHFATBLJG")), 0.92).when(F.size(pans) > 0, 0.50).otherwise(0.0),
        F.when(F.exists(phones, lambda n: F.substring(n, -10, 1).isin(*"6789")), 0.80).when(F.size(phones) > 0, 0.40).otherwise(0.0),
        F.when(text.rlike("(?i)" + IFSC), 0.85).otherwise(0.0),
        *(F.when(text.rlike("(?i)" + p), c).otherwise(0.0) for p, c in OBFUSCATED),
    ]
    spoken = sign | F.contains(F.lower(text), F.lit("at the rate"))
    address = F.when(sign & text.rlike("(?i)" + UPI), 0.88).when(spoken & text.rlike("(?i)" + UPI_SPOKEN), 0.66).otherwise(0.0)
    return F.greatest(F.when(digit, F.greatest(*numbers)).otherwise(0.0), address)


def verhoeff_plain(number: str) -> bool:
    check = 0
    for i, c in enumerate(reversed(number)):
        check = _multiply(check, _POWERS[i % 8][int(c)])
    return bool(number) and check == 0


def spans(text: str | None) -> list[dict]:
    """Identifiers with their places: of overlapping ones the surest, then the first, is kept."""
    text, hits = text or "", []

    def take(kind: str, pattern: str, confidence) -> None:
        for m in re.finditer(pattern, text, re.I):
            c = confidence(m.group()) if callable(confidence) else confidence
            if c is not None and c >= LEAST_CONFIDENCE:
                hits.append((kind, m.group(), m.start(), m.end(), float(c)))

    number = lambda s: re.sub("[^0-9]", "", s)
    if "@" in text:
        take("UPI_VPA", UPI, 0.88)
    if "@" in text or "at the rate" in text.lower():
        take("UPI_VPA", UPI_SPOKEN, 0.66)
    if re.search(r"\d", text):
        _take_numbers(take, number)
    kept: list[tuple] = []
    for h in sorted(hits, key=lambda h: (-h[4], h[2], h[3], h[0])):
        if all(h[3] <= k[2] or h[2] >= k[3] for k in kept):
            kept.append(h)
    return [dict(zip(("kind", "text", "start", "end", "confidence"), h, strict=True)) for h in sorted(kept, key=lambda h: h[2])]


def _take_numbers(take, number) -> None:
    take("IN_AADHAAR", TWELVE, lambda s: (0.95 if verhoeff_plain(number(s)) else 0.55) if len(number(s)) == 12 else None)
    take("IN_PAN", PAN, lambda s: 0.92 if re.sub(r"[ .\-]", "", s).upper()[3] in "PCHFATBLJG" else 0.50)
    take("IN_PHONE", PHONE, lambda s: (0.80 if number(s)[-10] in "6789" else 0.40) if 10 <= len(number(s)) <= 13 else None)
    take("IN_IFSC", IFSC, 0.85)
    for pattern, confidence in OBFUSCATED:
        take("IN_AADHAAR", pattern, confidence)


def scanned(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """``spans`` of each text; a batch stays in Arrow, and one text at a time becomes a Python string."""
    for batch in texts:
        yield pa.array((spans(t.as_py()) for t in batch), type=FOUND)


def span_column(text: Column) -> Column:
    @F.arrow_udf(SPANS)
    def scan(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scanned(texts)

    return scan(text)


def folded_question(text: Column) -> Column:
    """A question for comparing: NFKC, case folding, runs of characters that no word has as one space.

    Spark has neither of the first two beyond ASCII, so these are an Arrow function; the rest stays on the JVM.
    ``question`` is the form for ASCII, on the JVM alone.
    """

    @F.pandas_udf("string")
    def fold(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([t if t is None else unicodedata.normalize("NFKC", t).casefold() for t in batch], dtype=object)

    return F.trim(F.regexp_replace(fold(text), r"[^\p{L}\p{N}_]+", " "))
