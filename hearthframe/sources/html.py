"""Listings from captured result pages.

Python finds the elements of each card and hands out their raw texts; everything after that is Column
expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from hearthframe.functions import text as X
from hearthframe.schema import CORE, EXTRA

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: Elements whose content is not, or not everywhere, markup.
RAW = frozenset("iframe noembed noframes noscript plaintext script style textarea title xmp".split())
#: Plain markup: a text, a start tag with quoted attributes, or an end tag, on whose reading there are no two opinions.
_TOKEN = re.compile(r"""([^<]+)|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n]+[a-zA-Z][-_a-zA-Z0-9]*="[^"]*")*)[ \t\n]*(/?)>|</([a-zA-Z][a-zA-Z0-9]*)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][-_a-zA-Z0-9]*)="([^"]*)\"""")


class Node:
    """An element: its tag, attributes, and children in order, elements or strings."""

    __slots__ = ("attrs", "children", "found", "tag")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.children, self.found = tag, attrs, [], None

    def below(self) -> list[Node]:
        """Elements below this one in document order, found once; the tree must be whole by then."""
        if self.found is None:
            self.found, stack = [], [c for c in reversed(self.children) if isinstance(c, Node)]
            while stack:
                node = stack.pop()
                self.found.append(node)
                if node.children:
                    stack += [c for c in reversed(node.children) if isinstance(c, Node)]
        return self.found

    def all(self, test: Callable[[Node], bool]) -> list[Node]:
        return [n for n in self.below() if test(n)]

    def first(self, test: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.below() if test(n)), None)

    def strings(self, skip: Node | None = None) -> Iterator[str]:
        stack = list(reversed(self.children))
        while stack:
            c = stack.pop()
            if isinstance(c, str):
                yield c
            elif c is not skip:
                stack += reversed(c.children)

    def text(self, skip: Node | None = None, between: str = "") -> str:
        return between.join(self.strings(skip))


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = Node("", {})
        self.open = [self.top]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _plain_tree(page: str) -> Node | None:
    """What the builder makes of a page of plain markup, in a third of the time; None for any other page."""
    top = Node("", {})
    open_, end = [top], 0
    for m in _TOKEN.finditer(page):
        if m.start() != end:
            return None
        end = m.end()
        data, tag, attrs, alone, closed = m.groups()
        if data is not None:
            open_[-1].children.append(unescape(data) if "&" in data else data)
        elif tag is not None:
            tag = tag.lower()
            if tag in RAW or "&" in attrs:
                return None
            node = Node(tag, {k.lower(): v for k, v in _ATTRIBUTE.findall(attrs)} if attrs else {})
            open_[-1].children.append(node)
            if not alone and tag not in VOID:
                open_.append(node)
        else:
            closed = closed.lower()
            for k in range(len(open_) - 1, 0, -1):
                if open_[k].tag == closed:
                    del open_[k:]
                    break
    return top if end == len(page) else None


def _built_tree(page: str) -> Node:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    return builder.top


def parse(page: str | None) -> Node:
    """The element tree of a page; unclosed elements stay open, stray ends are passed over."""
    plain = _plain_tree(page or "")
    return _built_tree(page or "") if plain is None else plain


def has(part: str, tag: str | None = None) -> Callable[[Node], bool]:
    """Elements whose class attribute contains this part."""
    return lambda n: part in n.attrs.get("class", "") and tag in (None, n.tag)


def token(name: str, tag: str | None = None) -> Callable[[Node], bool]:
    """Elements with this class."""
    return lambda n: name in n.attrs.get("class", "").split() and tag in (None, n.tag)


def named(tag: str) -> Callable[[Node], bool]:
    return lambda n: n.tag == tag


def _text(node: Node | None) -> str | None:
    return None if node is None else node.text()


def _inside(node: Node, outer: Callable[[Node], bool], inner: Callable[[Node], bool]) -> list[Node]:
    """Elements for inner below elements for outer, in document order, each once."""
    seen: dict[int, Node] = {id(x): x for o in node.all(outer) for x in o.all(inner)}
    return [n for n in node.below() if id(n) in seen]


def _zonaprop(card: Node) -> dict:
    price = card.first(has("postingPrices-module__price"))
    discount = price and price.first(has("discount"))
    link = next(iter(_inside(card, has("postingCard-module__posting-description"), named("a"))), None)
    return {
        "price_raw": _text(price), "price": price and price.text(skip=discount), "discount": _text(discount), "title": _text(link),
        "address": _text(card.first(has("postingLocations-module__location-address"))), "expenses": _text(card.first(has("postingPrices-module__expenses"))),
        "features": [n.text() for n in card.all(has("postingMainFeatures-module__posting-main-features-span"))],
        "href": link and link.attrs.get("href"), "highlight": _text(card.first(has("postingCard-module__highlight"))),
    }


def _linked(card: Node) -> str | None:
    link = card.first(lambda n: n.tag == "a" and "href" in n.attrs)
    return link and link.attrs["href"]


def _argenprop(card: Node) -> dict:
    price = _text(card.first(token("card__price", "p")))
    return {
        "price_raw": price, "price": price, "expenses": _text(card.first(token("card__expenses", "span"))), "address": _text(card.first(token("card__address", "p"))),
        "title": _text(card.first(token("card__title", "h2"))), "info": _text(card.first(token("card__info", "p"))),
        "features": [n.text() for n in _inside(card, token("card__main-features", "ul"), named("li"))], "href": _linked(card),
        "visited": _text(card.first(token("card__visited", "span"))), "points": _text(card.first(token("card__points", "p"))),
    }


def _cabaprop(card: Node) -> dict:
    price = _text(card.first(token("lc-price-normal", "span")))
    content = card.first(token("tc_content", "div"))
    place = content and content.first(named("p"))
    strong = place and place.first(named("strong"))
    badge = content and content.first(token("badge_icon", "div"))
    logo = badge and badge.first(named("img"))
    dated = card.first(lambda n: n.tag == "span" and len(n.children) == 1 and isinstance(n.children[0], str) and "Publicado el" in n.children[0])
    return {
        "price_raw": price, "price": price, "expenses": _text(card.first(token("lc-price-small", "span"))),
        "title": content and (_text(content.first(named("h4"))) or ""), "address": _text(place), "strong": _text(strong),
        "address_parts": [c for c in place.children if isinstance(c, str)] if place else None,
        "features": [n.text() for n in _inside(card, token("prop_details", "ul"), named("li"))], "href": _linked(card),
        "logo": logo and logo.attrs.get("alt", ""), "published": _text(dated),
    }


#: Where the cards of each portal are, and what reads one.
CARDS = {
    "zonaprop": (has("postingCardLayout-module__posting-card-layout", "div"), _zonaprop),
    "argenprop": (token("listing__item", "div"), _argenprop),
    "cabaprop": (token("cards", "div"), _cabaprop),
}
_PARTS = ["price_raw", "price", "discount", "title", "address", "expenses", "href", "highlight", "info", "visited", "points", "strong", "logo", "published", "error"]
CARD = T.ArrayType(T.StructType([*(T.StructField(p, T.StringType()) for p in _PARTS), *(T.StructField(p, T.ArrayType(T.StringType())) for p in ("address_parts", "features"))]))


def cards(page: str | None, portal: str | None, readers: dict | None = None) -> list[dict]:
    """The raw parts of each card of a page; a card that can't be read has only an error."""
    readers = readers or CARDS
    if portal not in readers:
        return []
    test, read = readers[portal]
    out = []
    for card in parse(page).all(test):
        try:
            out.append(read(card))
        except Exception as e:  # one bad card must not lose the page
            out.append({"error": repr(e)})
    return out


def cards_of(html: Column, portal: Column, readers: dict | None = None) -> Column:
    """The cards of a page as an array of raw parts."""
    kind = to_arrow_type(CARD)

    def run(pages: pa.Array, portals: pa.Array) -> pa.Array:
        return pa.array([cards(h, p, readers) for h, p in zip(pages.to_pylist(), portals.to_pylist(), strict=True)], kind)

    return F.arrow_udf(run, CARD)(html, portal)


#: Which words make a feature which field, in the order in which they are tried.
FEATURES = {
    "zonaprop": [("Metros_Totales", ["tot"]), ("Metros_Cubiertos", ["cub", "m²"]), ("Ambientes", ["amb"]), ("Dormitorios", ["dorm"]), ("Baños", ["baño"]), ("Cocheras", ["coch"])],
    "argenprop": [("Metros_Cubiertos", ["m²"]), ("Baños", ["baño"]), ("Dormitorios", ["dorm"]), ("Ambientes", ["amb"]), ("Antiguedad", ["años", "estrenar"])],
    "cabaprop": [("Ambientes", ["amb"]), ("Dormitorios", ["dorm"]), ("Baños", ["baño"]), ("Metros_Totales", ["total"]), ("Metros_Cubiertos", ["cubierto"])],
}
HOSTS = {"zonaprop": "https://www.zonaprop.com.ar", "argenprop": "https://www.argenprop.com", "cabaprop": "https://cabaprop.com.ar"}


def kinds(portal: str, features: Column) -> Column:
    """Each feature's field and digits, as an array of (field, value)."""
    texts = F.transform(features, X.clean_text)
    return F.transform(texts, lambda t: F.struct(X.classify(t, FEATURES[portal]).alias("field"), X.force_int(t).alias("value")))


def feature(field: str, found: Column) -> Column:
    """The last value of this field among kinds(); null if there is none."""
    own = F.filter(found, lambda k: k["field"] == field)
    return F.when(F.size(own) > 0, F.element_at(own, -1)["value"])


def _if_found(part: Column, value: Column) -> Column:
    return F.when(part.isNotNull(), value)


def _rooms(field: Column, text: Column) -> Column:
    return F.when(F.coalesce(field, F.lit("")) == "", F.coalesce(F.nullif(X.rooms_in(text), F.lit("")), field)).otherwise(field)


def fields(portal: str, card: Column, found: Column, title: Column) -> dict[str, Column]:
    """The listing fields that a portal's card gives, from its parts, kinds() and cleaned title."""
    part = lambda name: card[name]
    out = {kind: feature(kind, found) for kind, _ in FEATURES[portal]}
    if portal == "zonaprop":
        place, lead = X.clean_text(part("address")), F.substring_index(title, "-", 1)
        return out | {
            "Precio": F.when(part("price").isNull(), F.lit("")).otherwise(X.force_int(part("price"))), "Bajo_Precio": part("discount").isNotNull(), "Porcentaje_Rebaja": X.clean_text(part("discount")),
            "Titulo": title, "Direccion": F.when(~X.has_digit(place) & part("title").isNotNull() & X.has_digit(lead), F.trim(lead)).otherwise(place),
            "Expensas": X.force_int(part("expenses")), "URL": X.absolute_url(F.nullif(part("href"), F.lit("")), HOSTS[portal]), "Etiqueta_Destacado": _if_found(part("highlight"), X.clean_text(part("highlight"))),
        }
    common = {"Expensas": _if_found(part("expenses"), X.force_int(part("expenses")))}
    if portal == "argenprop":
        info = X.clean_text(part("info"))
        return out | common | {
            "Precio": _if_found(part("price"), X.force_int(F.substring_index(part("price"), "+", 1))), "Direccion": _if_found(part("address"), X.clean_text(part("address"))), "Titulo": title, "Descripcion_Breve": info,
            "Ambientes": _rooms(out["Ambientes"], F.concat_ws(" ", title, info)), "URL": F.concat(F.lit(HOSTS[portal]), part("href")),
            "Visto_Estado": _if_found(part("visited"), X.clean_text(part("visited"))), "Visitas_Count": _if_found(part("points"), X.force_int(part("points"))),
        }
    own = F.filter(F.transform(part("address_parts"), X.clean_text), lambda t: X.has_digit(t) & (F.length(t) > 3))
    rest = F.when(F.coalesce(part("strong"), F.lit("")) == "", part("address")).otherwise(F.replace(part("address"), part("strong"), F.lit("")))
    return out | common | {
        "Precio": _if_found(part("price"), X.force_int(part("price"))), "Titulo": _if_found(part("title"), title),
        "Direccion": F.when(F.size(own) > 0, own[0]).otherwise(_if_found(part("address"), X.clean_text(rest))), "Ambientes": _rooms(out["Ambientes"], F.coalesce(title, F.lit(""))),
        "Inmobiliaria": part("logo"), "URL": X.absolute_url(part("href"), HOSTS[portal]), "Fecha_Publicacion": _if_found(part("published"), X.without(X.clean_text(part("published")), "Publicado el")),
    }


def raw_listings(pages: DataFrame, max_pages: int | None = 3, carry: tuple[str, ...] = ()) -> DataFrame:
    """Captured pages (portal, barrio, tipo, page_no, seq, html) -> listings in the superset schema, with seq, page_no, card_no and the carried columns.

    Cards priced in dollars and cards that can't be read are left out; nothing is deduplicated yet.
    """
    if max_pages is not None:
        pages = pages.where(F.col("page_no") <= max_pages)
    found = pages.select("portal", "barrio", "tipo", "page_no", "seq", *carry, F.posexplode(cards_of(F.col("html"), F.col("portal"))).alias("card_no", "card"))
    found = found.where(F.col("card.error").isNull() & ~X.is_usd(F.col("card.price_raw")))
    known = {"Portal": F.col("portal"), "Barrio": F.col("barrio"), "Tipo": X.type_label(F.col("tipo"))}

    def listed(portal: str) -> DataFrame:
        own = found.where(F.col("portal") == portal).withColumn("found", kinds(portal, F.col("card.features"))).withColumn("title", X.clean_text(F.col("card.title")))
        made = known | fields(portal, F.col("card"), F.col("found"), F.col("title"))
        kind = {c: "boolean" if c == "Bajo_Precio" else "string" for c in CORE + EXTRA}
        return own.select("seq", "page_no", "card_no", *carry, *(made.get(c, F.lit(None)).cast(kind[c]).alias(c) for c in kind))

    first, *rest = (listed(p) for p in CARDS)
    for other in rest:
        first = first.unionByName(other)
    return first


# --- flat elements of any page --------------------------------------------------------------------


def links(html: Column) -> Column:
    """The href values of a page's anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*href="([^"]*)"'), F.lit(1))


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def lang(html: Column) -> Column:
    return F.regexp_extract(html, r'(?i)<html[^>]*\slang="([^"]*)"', 1)
