"""Filters, keep-first deduplication and column order of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.schema import CORE, PORTAL_COLUMNS

#: What marks a one-room flat, and the accepted prices.
ONE_ROOM = ["monoambiente", "mono ambiente", "monoamb", "1 ambiente", "1 amb"]
PRICES = (10_000, 999_999)


def is_excluded(title: Column, info: Column, rooms: Column, terms: list[str] | None = None, mode: str = "compat") -> Column:
    """Whether a listing is for one room.

    compat: a term is part of the lower-case title, info and rooms, joined by spaces, or is so once all
    spaces are gone; or rooms is 1. A null prints as nan. strict: terms must not follow another digit or
    letter, and fields are looked at one by one.
    """
    terms = terms or ONE_ROOM
    if mode == "strict":
        pattern = "|".join(rf"(?<![\p{{L}}\p{{N}}]){t.replace(' ', ' *')}" for t in terms)
        return X.any_of([F.coalesce(F.lower(c).rlike(pattern), F.lit(False)) for c in (title, info)]) | F.coalesce(rooms == "1", F.lit(False))
    every = F.lower(F.concat_ws(" ", X.as_text(title), X.as_text(info), X.as_text(rooms)))
    close = F.replace(every, F.lit(" "), F.lit(""))
    return X.any_of([every.contains(t) | close.contains(t.replace(" ", "")) for t in terms]) | F.coalesce(rooms == "1", F.lit(False))


def is_valid_price(price: Column, low: int = PRICES[0], high: int = PRICES[1]) -> Column:
    """Digits only, and within the bounds, both included."""
    return F.coalesce(price.rlike(r"^[0-9]+\z") & price.try_cast("bigint").between(low, high), F.lit(False))


def keep_first(df: DataFrame, keys: list[str], order: list[str], null_exempt: bool = False) -> DataFrame:
    """The first row of each key by the order columns, ascending with nulls first.

    With null_exempt, rows with a null or empty key all stay; else nulls are one key. Firsts are picked
    before rows are shuffled, so a key with very many rows is no burden.
    """
    if null_exempt:
        empty = X.any_of([F.coalesce(F.col(k).cast("string"), F.lit("")) == "" for k in keys])
        # a key of its own for each exempt row: two filtered halves would make df twice
        return keep_first(df.withColumn("_alone", F.when(empty, F.monotonically_increasing_id())), [*keys, "_alone"], order).drop("_alone")
    first = df.groupBy(*keys).agg(F.min_by(F.struct("*"), F.struct(*order)).alias("_first"))
    return first.select("_first.*")


def first_labels(listings: DataFrame) -> DataFrame:
    """Crawl-time deduplication: of each portal's listings with one URL the first stays, with its labels; those without a URL stay."""
    return keep_first(listings, ["Portal", "URL"], ["seq", "page_no", "card_no"], null_exempt=True)


def cleaned(listings: DataFrame, mode: str = "compat") -> DataFrame:
    """Portal listings without one-room and oddly priced ones, one row for each URL (nulls are one URL)."""
    info = F.when(F.col("Portal").isin(*(p for p, c in PORTAL_COLUMNS.items() if "Descripcion_Breve" in c)), X.as_text(F.col("Descripcion_Breve"))).otherwise(F.lit(""))
    kept = listings.where(~is_excluded(F.col("Titulo"), info, F.col("Ambientes"), mode=mode) & is_valid_price(F.col("Precio")))
    return keep_first(kept, ["Portal", "URL"], ["seq", "page_no", "card_no"])


def cleaned_and_counted(listings: DataFrame, mode: str = "compat") -> tuple[DataFrame, Observation, Observation]:
    """cleaned(), with the rows before and after, which are counted as they pass when the result is computed: no second pass.

    removed(before, after) reads them then.
    """
    before, after = Observation(), Observation()
    kept = cleaned(listings.observe(before, F.count("*").alias("rows")), mode)
    return kept.observe(after, F.count("*").alias("rows")), before, after


def removed(before: Observation, after: Observation) -> int:
    """Rows that cleaning took out; waits for the first action on its result."""
    return before.get["rows"] - after.get["rows"]


def ordered(df: DataFrame, drop: tuple[str, ...] = ("Ubicacion", "seq", "page_no", "card_no")) -> DataFrame:
    """The core columns that df has, in their order, then the others by name."""
    core = [c for c in CORE if c in df.columns]
    return df.select(*core, *sorted(c for c in df.columns if c not in core and c not in drop))


def with_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """Exactly these columns; those that are missing are empty texts."""
    return df.select(*(F.col(c) if c in df.columns else F.lit("").alias(c) for c in names))
