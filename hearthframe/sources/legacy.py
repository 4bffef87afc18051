"""Listings as an earlier set of rules read them: texts as they are, one column for the area, other defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators.clean import with_columns
from hearthframe.sources.html import CARDS, HOSTS, Node, _inside, _linked, _text, cards_of, has, named, token

#: The columns of the old files, and the old feature words. Words in lower case match any case.
COLUMNS = ["Precio", "Expensas", "Direccion", "Metros", "Ambientes", "Dormitorios", "Baños", "Cocheras", "Titulo", "URL"]
FEATURES = {
    "zonaprop": [("Metros", "m²", True), ("Ambientes", "amb", False), ("Dormitorios", "dorm", False), ("Baños", "baño", False), ("Cocheras", "coch", False)],
    "argenprop": [("Metros", "m²", True), ("Dormitorios", "dorm", False), ("Baños", "baño", False)],
    "cabaprop": [("Metros_Totales", "m² total", True), ("Metros_Cubiertos", "m² cubierto", True), ("Ambientes", "Ambientes", True), ("Dormitorios", "Dorm", True), ("Baños", "Baño", True)],
}


def _zonaprop(card: Node) -> dict:
    return {
        "price": _text(card.first(has("postingPrices-module__price"))), "expenses": _text(card.first(has("postingPrices-module__expenses"))),
        "address": _text(card.first(has("postingLocations-module__location-address"))), "title": _text(card.first(named("h2"))), "href": _linked(card),
        "features": [n.text() for n in card.all(has("postingMainFeatures-module__posting-main-features-span"))],
    }


def _argenprop(card: Node) -> dict:
    return {
        "price": _text(card.first(token("card__price", "p"))), "expenses": _text(card.first(token("card__expenses", "span"))), "address": _text(card.first(token("card__address", "p"))),
        "href": _linked(card), "features": [n.text() for n in card.all(named("li"))],
    }


def _cabaprop(card: Node) -> dict:
    content, details, found = card.first(token("tc_content", "div")), card.first(token("details", "div")), card.first(token("prop_details", "ul"))
    place = content and content.first(named("p"))
    return {
        "price": _text(card.first(token("lc-price-normal", "span"))), "expenses": _text(card.first(token("lc-price-small", "span"))),
        "title": content and (_text(content.first(named("h4"))) or ""), "address_parts": place and list(place.strings()), "href": details and _linked(details),
        "features": [n.text(between=" ") for n in found.all(named("li"))] if found else [],
    }


READERS = {p: (CARDS[p][0], read) for p, read in (("zonaprop", _zonaprop), ("argenprop", _argenprop), ("cabaprop", _cabaprop))}


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _feature(portal: str, field: str, features: Column) -> Column:
    """The last feature that is of this field and of none before it."""
    texts = F.transform(features, _strip)

    def of(t: Column) -> Column:
        out = None
        for name, word, cased in FEATURES[portal]:
            test = (t if cased else F.lower(t)).contains(word)
            out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
        return out

    own = F.filter(texts, lambda t: of(t) == field)
    return F.when(F.size(own) > 0, F.element_at(own, -1))


def _or_empty(text: Column) -> Column:
    return F.coalesce(_strip(text), F.lit(""))


def fields(portal: str, card: Column) -> dict[str, Column]:
    out = {name: _feature(portal, name, card["features"]) for name, _, _ in FEATURES[portal]}
    href = card["href"]
    if portal == "zonaprop":
        url = F.coalesce(F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(HOSTS[portal]), href)), F.lit(""))
        out |= {c: F.coalesce(out[c], F.lit("")) for c in ("Metros", "Ambientes", "Dormitorios")}
        return out | {"Precio": _or_empty(card["price"]), "Expensas": _or_empty(card["expenses"]), "Direccion": _or_empty(card["address"]), "Titulo": _or_empty(card["title"]), "URL": url}
    url = F.concat(F.lit(HOSTS[portal]), href)
    if portal == "argenprop":
        return out | {"Precio": _or_empty(card["price"]), "Expensas": _or_empty(card["expenses"]), "Direccion": _or_empty(card["address"]), "URL": url}
    place = F.element_at(F.split(F.array_join("card.address_parts", "|"), r"\|"), -1)
    return out | {
        "Precio": F.coalesce(_strip(card["price"]), F.lit("Consultar")), "Expensas": F.coalesce(X.without(_strip(card["expenses"]), "Expensas:"), F.lit("")),
        "Titulo": _strip(card["title"]), "Direccion": _strip(place), "URL": url,
    }


def legacy_listings(pages: DataFrame, portal: str, max_pages: int = 3) -> DataFrame:
    """Captured pages of one portal -> listings with the columns of the old files, all rows, not deduplicated.

    Columns that no card has are empty texts; the two areas that cabaprop's cards give have no column in
    the old files and are left out, as they were.
    """
    found = pages.where((F.col("portal") == portal) & (F.col("page_no") <= max_pages)).select(F.explode(cards_of(F.col("html"), F.col("portal"), READERS)).alias("card"))
    made = fields(portal, F.col("card"))
    return with_columns(found.where("card.error IS NULL").select(*(c.alias(n) for n, c in made.items())), COLUMNS)
