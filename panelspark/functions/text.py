"""Text scalars as Column expressions. White space is Unicode white space, so patterns carry (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters that recognised text may keep, and noise made of digits and marks alone.
KEPT = r"(?U)[^A-Z0-9\s.,!?'\"~-]"
NOISE = r"(?U)^[O0-9\s.,!?'\"~-]+$"
#: Fixed value: the marker between texts of one request.
SEPARATOR = "130495848"


def strip(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def clean_line(x: Column) -> Column:
    """Recognised text in capitals with brackets read as I, other characters dropped and blanks collapsed. A pattern of blanks
    meets only what is not a single blank already, so that most words cost no replacement."""
    kept = F.regexp_replace(F.regexp_replace(F.upper(x), r"[|\[\]{}]", "I"), KEPT + "+", "")
    return F.trim(F.regexp_replace(kept, r"(?U)[^\S ]\s*| \s+", " "))


def is_noise(x: Column) -> Column:
    return (F.length(x) < 6) & x.rlike(NOISE)


def letters(x: Column) -> Column:
    return F.regexp_replace(x, "[^A-Z]", "")


def has_letters(x: Column, n: int) -> Column:
    """Whether there are n capitals at least; a search ends at the last of them."""
    return x.rlike(f"(?:[A-Z][^A-Z]*+){{{n}}}")


def words(x: Column) -> Column:
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def safe_title(x: Column) -> Column:
    return F.left(strip(F.regexp_replace(x, r"(?U)[^a-zA-Z0-9_\-\s]", "_")), F.lit(100))


def safe_chapter(x: Column) -> Column:
    return F.left(strip(F.regexp_replace(collapse(x), r"[^a-zA-Z0-9 _.\-]", "_")), F.lit(100))


def zero_filled(x: Column, width: int = 3) -> Column:
    s = x.cast("string")
    return F.lpad(s, F.greatest(F.lit(width), F.length(s)), F.lit("0"))


def clean_answer(x: Column) -> Column:
    """Without list number, and without a label before the first colon that names the translation."""
    bare = F.regexp_replace(strip(x), r"(?U)^\d+[.\)]\s*", "")
    parts = F.split(bare, ":", 2)
    labelled = (F.size(parts) == 2) & F.contains(F.lower(parts[0]), F.lit("terjemah"))
    return F.when(labelled, strip(F.get(parts, F.lit(1)))).otherwise(bare)


def lines(x: Column) -> Column:
    return F.filter(F.transform(F.split(x, "\n"), strip), lambda v: v != "")


def extract_answers(x: Column) -> Column:
    """The parts between separators, cleaned, empty ones dropped; without separator the lines; or the text itself."""
    by_mark = F.filter(F.transform(F.split(x, SEPARATOR), clean_answer), lambda v: v != "")
    by_line = F.transform(lines(x), clean_answer)
    return F.when(F.contains(x, F.lit(SEPARATOR)), by_mark).when(F.size(by_line) > 0, by_line).otherwise(F.array(x))


def verified_answers(x: Column, expected: Column) -> Column:
    """The answers if there are as many as expected, else the lines without separator if those are, else null."""
    first = extract_answers(x)
    plain = F.transform(F.filter(lines(x), lambda v: ~F.contains(v, F.lit(SEPARATOR))), clean_answer)
    return F.when(F.length(x) == 0, None).when(F.size(first) == expected, first).when(F.size(plain) == expected, plain)
