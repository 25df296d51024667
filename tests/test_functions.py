"""Scalar functions on hand-computed cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bocage.functions import codes, geo, numbers, text


def value(spark, column, **cells):
    names = {k: (v,) for k, v in cells.items()}
    kinds = {str: "string", float: "double", int: "long", bool: "boolean", dt.date: "date", type(None): "string"}
    schema = ", ".join(f"{k} {kinds[type(v[0])]}" for k, v in names.items())
    return spark.createDataFrame([tuple(v[0] for v in names.values())], schema).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("f", "given", "expected"),
    [
        (text.clean_text, " a\x01b \t c ", "a b c"), (text.clean_text, " \t ", None), (text.non_empty, "  ", None), (text.non_empty, None, None),
        (text.compare_key, "L'Œuvre-de  St.Éloi", "l oeuvre de st eloi"), (text.commune_key, "STE-Marie s/ Vauge CEDEX 2", "saintemariesurvauge"),
        (text.commune_name, "St-Étienne, l’Île", "SAINT ETIENNE L ILE"), (text.key_field, " 1 rue straße x CEDEX 9 ", "1 RUE STRASSE X"),
        (text.key_field, None, ""), (text.geocoder_line, "0012 RUE X, Hall 2", "12 RUE X"), (text.geocoder_line, "000 RUE X", "RUE X"),
        (text.geocoder_line, "0,13008", "0,13008"), (text.geocoder_line, "Maison, 12 rue", "Maison, 12 rue"), (text.first_phone, "01.02-03 (04) 05/06", "0102030405"),
        (text.expand_abbreviations, "12 bd st michel", "12 boulevard saint michel"),
        (numbers.strict_number, "1,5", None), (numbers.strict_number, "-2.50", -2.5), (numbers.strict_number, "3\n", None), (numbers.loose_number, "1,5", 1.5),
        (numbers.loose_number, "NaN", None), (numbers.loose_coordinate, " 7,25 E", 7.25), (numbers.loose_coordinate, "x", None),
        (numbers.strict_boolean, "TRUE", True), (numbers.strict_boolean, "oui", False), (numbers.boolean_fallback, "oui", True), (numbers.boolean_fallback, "False", False),
        (numbers.count_label, 999, "999"), (numbers.count_label, 7006, "7.0K"), (numbers.count_label, 12_999, "12K"), (numbers.count_label, 1_550_000, "1.6M"),
        (numbers.count_label, -5, "-5"), (numbers.strict_date, "2024-02-30", None), (numbers.strict_date, "1899-01-01", None), (numbers.strict_date, "2024-02-29", dt.date(2024, 2, 29)),
        (codes.valid_department, "20", False), (codes.valid_department, "2A", True), (codes.valid_department, None, False), (codes.department_of_insee, "97411", "974"),
        (codes.department_of_insee, "2A004", "2A"), (codes.department_of_postal, "20100", None), (codes.department_of_postal, "99123", None), (codes.department_of_postal, "75001", "75"),
        (codes.parent_commune, "75112", "75056"), (codes.parent_commune, "01910", "01910"), (codes.naf_key, " 86.21z ", "8621Z"), (codes.postal_prefix, " 01200 X", "01200"),
    ],
)
def test_scalars(spark, f, given, expected):
    assert value(spark, f(F.col("v")), v=given) == expected


def test_rounding(spark):
    assert value(spark, numbers.round_half_up(F.col("v"), 0), v=-2.5) == -2.0
    assert value(spark, numbers.km(F.col("v")), v=1234.0) == 1.23
    assert value(spark, numbers.km(F.col("v")), v=float("nan")) is None


@pytest.mark.parametrize(
    ("a", "b", "expected"),
    [("night", "nacht", 0.25), ("aa", "aaaa", 0.5), ("x", "x", 1.0), ("x", "y", 0.0), ("", "", 1.0), ("", "ab", 0.0), (None, "ab", None), (None, None, None)],
)
def test_dice(spark, a, b, expected):
    assert value(spark, text.dice(F.col("a"), F.col("b")), a=a, b=b) == expected


def test_trigrams(spark):
    assert value(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 11)
    assert value(spark, text.word_similarity(F.col("a"), F.col("b")), a="word", b="two words") == pytest.approx(4 / 7)
    assert value(spark, text.word_similarity(F.col("a"), F.col("b")), a="two", b="one two three") == 1.0
    assert value(spark, text.trigram_similarity(F.col("a"), F.col("b")), a="", b="") == 0.0


def test_points_and_distances(spark):
    assert value(spark, geo.point_lon(F.col("g")), g="srid=4326; Point( -1.5  44 )") == -1.5
    for bad in ("POINT EMPTY", "", "POINT(1)", "LINESTRING(1 2,3 4)", None):
        assert value(spark, geo.point_lat(F.col("g")), g=bad) is None
    one = value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.col("y")), y=1.0)
    assert one == pytest.approx(geo.METRES_PER_DEGREE)
    assert value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(180.0), F.col("y")), y=0.0) == pytest.approx(geo.METRES_PER_DEGREE * 180)


def test_lambert93(spark):
    df = spark.createDataFrame([(700_000.0, 6_600_000.0), (652_469.02, 6_862_035.26)], "x double, y double")
    got = [(r["lon"], r["lat"]) for r in df.select(geo.lambert93_lon(F.col("x"), F.col("y")).alias("lon"), geo.lambert93_lat(F.col("x"), F.col("y")).alias("lat")).collect()]
    assert got[0] == pytest.approx((3.0, 46.5), abs=1e-7)
    assert got[1] == pytest.approx((2.3522, 48.8566), abs=2e-3)
