"""Column functions that turn noisy listing text into values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The spellings of dollars, the words before "amb", and what an address is stripped of and given.
DOLLARS = ["USD", "U$S", "DOLARES", "US$"]
ROOM_WORDS = {"dos amb": "2", "tres amb": "3", "cuatro amb": "4"}
ADDRESS_NOISE = r"(?i)C\.A\.B\.A|CABA| - "
ADDRESS_TAIL = ", Ciudad Autónoma de Buenos Aires, Argentina"

#: Characters that count as digits: decimal ones, and raised and lowered ones.
DIGIT = r"[\p{Nd}²³¹⁰⁴-⁹₀-₉]"


def any_of(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def clean_text(text: Column) -> Column:
    """Carriage returns go, runs of any white space become one space, ends are trimmed; null gives ''."""
    gone = F.regexp_replace(F.coalesce(text, F.lit("")), "\r", "")
    return F.trim(F.regexp_replace(gone, r"(?U)[\s\x1c-\x1f]+", " "))


def force_int(text: Column) -> Column:
    """All digits of a text, as a string; '0' for brand-new ("estrenar"), '' for null or none."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.lower(text).contains("estrenar"), F.lit("0")).otherwise(F.regexp_replace(text, r"[^\p{Nd}]", ""))


def is_usd(text: Column) -> Column:
    upper = F.upper(F.coalesce(text, F.lit("")))
    return any_of([upper.contains(d) for d in DOLLARS])


def rooms_in(text: Column) -> Column:
    """The number before "amb", else a number word before it, else ''."""
    text = F.coalesce(text, F.lit(""))
    found = F.nullif(F.regexp_extract(text, r"(?i)(\p{Nd}+)(?U)\s*amb", 1), F.lit(""))
    for words, n in ROOM_WORDS.items():
        found = F.coalesce(found, F.when(F.lower(text).contains(words), F.lit(n)))
    return F.coalesce(found, F.lit(""))


def has_digit(text: Column) -> Column:
    return F.coalesce(text.rlike(DIGIT), F.lit(False))


def first_part(text: Column, mark: str) -> Column:
    return F.trim(F.substring_index(text, mark, 1))


def absolute_url(href: Column, host: str) -> Column:
    return F.when(href.startswith("/"), F.concat(F.lit(host), href)).otherwise(href)


def without(text: Column, literal: str) -> Column:
    return F.trim(F.replace(text, F.lit(literal), F.lit("")))


def classify(text: Column, kinds: list[tuple[str, list[str]]]) -> Column:
    """The first kind one of whose terms the lower-case text contains; null if none."""
    low, out = F.lower(text), None
    for kind, terms in kinds:
        test = any_of([low.contains(t) for t in terms])
        out = F.when(test, F.lit(kind)) if out is None else out.when(test, F.lit(kind))
    return out


def type_label(kind: Column) -> Column:
    return F.when(kind == "ph", F.lit("PH")).otherwise(F.lit("Departamento"))


def full_address(address: Column) -> Column:
    """The address that the address dimension is keyed by; null for null and blank addresses."""
    known = F.length(F.trim(clean_text(address))) > 0
    return F.when(known, F.concat(F.regexp_replace(address, ADDRESS_NOISE, " "), F.lit(ADDRESS_TAIL)))


def title_case(slug: Column) -> Column:
    return F.initcap(F.replace(slug, F.lit("-"), F.lit(" ")))


def recode(value: Column, table: dict[str, str]) -> Column:
    """Values in the table become others; the rest stay."""
    return F.coalesce(lookup(value, table), value)


def lookup(value: Column, table: dict[str, str]) -> Column:
    """The table's value; null if it has none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value)


def file_date(path: Column) -> Column:
    """The first yyyy-mm-dd in a file name; '' if there is none."""
    return F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"(\d{4}-\d{2}-\d{2})", 1)


def label(name: Column) -> Column:
    """A column name as a caption: spaces, one capital, a colon."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, F.lit(2), F.length(spaced))), F.lit(":"))


def as_text(value: Column) -> Column:
    """Nulls as the text nan, as a dataframe of mixed values prints them."""
    return F.coalesce(value.cast("string"), F.lit("nan"))
