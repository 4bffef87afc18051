import pytest
from pyspark.sql import functions as F

from hearthframe.functions import text as X
from hearthframe.operators import clean, metrics, unify


def value(spark, f, *args, kind="string"):
    schema = ", ".join(f"c{k} {kind}" for k in range(len(args)))
    return spark.createDataFrame([args], schema).select(f(*(F.col(f"c{k}") for k in range(len(args)))).alias("v")).first().v


@pytest.mark.parametrize(("f", "given", "want"), [
    (X.force_int, "45 m²", "45"), (X.force_int, "$ 650.000", "650000"), (X.force_int, "45,5 m²", "455"), (X.force_int, "35 a 40 m²", "3540"), (X.force_int, "A ESTRENAR", "0"), (X.force_int, None, ""), (X.force_int, "", ""),
    (X.is_usd, "U$S 900", True), (X.is_usd, "usd 900", True), (X.is_usd, "900 dólares", False), (X.is_usd, None, False),
    (X.clean_text, " a \n b\r ", "a b"), (X.clean_text, "a\rb c", "ab c"), (X.clean_text, None, ""),
    (X.rooms_in, "Depto 3amb", "3"), (X.rooms_in, "dos ambientes", "2"), (X.rooms_in, "un ambiente", ""), (X.rooms_in, None, ""),
    (X.has_digit, "a1", True), (X.has_digit, "m²", True), (X.has_digit, None, False),
    (X.full_address, "Gorriti 4000 - CABA", f"Gorriti 4000  {X.ADDRESS_TAIL}"), (X.full_address, " ", None), (X.full_address, None, None),
    (X.title_case, "villa-urquiza", "Villa Urquiza"), (X.label, "distancia_m_Gym", "Distancia m gym:"), (X.type_label, "ph", "PH"), (X.file_date, "a/2020-01-01/p_2024-03-05.csv", "2024-03-05"),
    (unify.day_first, "31/02/2024", None), (unify.lenient_long, "x", None), (unify.lenient_long, "12.0", 12), (unify.lenient_long, "12.5", None),
    (clean.is_valid_price, "10000", True), (clean.is_valid_price, "999999", True), (clean.is_valid_price, "9999", False), (clean.is_valid_price, "1000000", False), (clean.is_valid_price, "", False), (clean.is_valid_price, None, False),
])
def test_scalars(spark, f, given, want):
    assert value(spark, f, given) == want


def test_dates(spark):
    assert str(value(spark, unify.day_first, "05/03/2024")) == str(value(spark, unify.day_first, "5/3/2024")) == "2024-03-05"


@pytest.mark.parametrize(("title", "info", "rooms", "want"), [("Depto 11 ambientes", "x", "11", True), ("Cabildo 2001", "Ambiente luminoso", "3", True), ("Cabildo 2001", None, "3", False), ("x", "y", "1", True), ("Lindo 2 amb", "x", "2", False)])
def test_exclusion(spark, title, info, rooms, want):
    assert value(spark, clean.is_excluded, title, info, rooms) is want


def test_strict_exclusion(spark):
    strict = lambda *c: clean.is_excluded(*c, mode="strict")
    assert value(spark, strict, "Depto 11 ambientes", "x", "11") is False and value(spark, strict, "Lindo 1 amb", None, "2") is True


@pytest.mark.parametrize(("cost", "color"), [(None, "#808080"), (0.0, "#1a9850"), (299999.0, "#1a9850"), (300000.0, "#91cf60"), (1e7, "#67000d"), (-1.0, "#67000d")])
def test_bands(spark, cost, color):
    assert value(spark, metrics.band, cost, kind="double") == color


def test_keep_first(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 4), ("", 5)], "URL string, seq int")
    assert sorted(r.seq for r in clean.keep_first(rows, ["URL"], ["seq"]).collect()) == [1, 3, 5]
    assert sorted(r.seq for r in clean.keep_first(rows, ["URL"], ["seq"], null_exempt=True).collect()) == [1, 2, 3, 5]
