"""Problems 2, 5 and 6: defined results on hand-made rows."""

import datetime as dt

from pyspark.sql import functions as F

from bocage.operators import proximity, rejects, snapshots

GOOD = "1;2;A;B;;26;1 RUE X;;01100;Y;01910;0102030405;2024-02-29;1.5;-2"


def reasons(spark, *raws):
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(raws)], "raw_id long, raw string, reason string")
    return {r["raw_id"]: r["reason"] for r in rejects.rejected(df).collect()}


def changed(field, value):
    parts = GOOD.split(";")
    parts[rejects.FIELDS.index(field)] = value
    return ";".join(parts)


def test_reasons_in_order(spark):
    cases = [
        (GOOD, None),
        (GOOD + "\r\n", None),
        (GOOD.replace("A;", '"A ""le petit""";'), None),
        (changed("coordonnees_complement", '"bat C\nporte 6; fond"'), None),
        (changed("ps_activite_nom", 'A"B'), "quoting"),
        (changed("ps_activite_nom", '"A" x'), "quoting"),
        (changed("ps_activite_nom", '"A'), "quoting"),
        (GOOD + ";", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        (changed("id_ligne", ""), "id_ligne"),
        (changed("id_ligne", " 7 "), None),
        (changed("coordonnees_code_postal", "1100"), "code_postal"),
        (changed("code_insee", "96001"), "code_insee"),
        (changed("code_insee", "2A004"), None),
        (changed("code_insee", "2a004"), "code_insee"),
        (changed("code_insee", ""), None),
        (changed("date_maj", "2023-02-29"), "date_maj"),
        (changed("date_maj", "1899-12-31"), "date_maj"),
        (changed("longitude", "180.5"), "coordonnee"),
        (changed("latitude", "+90"), None),
        (changed("latitude", "1e1"), "coordonnee"),
        (changed("latitude", " "), None),
        (changed("id_ligne", "x").replace("2024-02-29", "?"), "id_ligne"),
        (changed("ps_activite_nom", '"' + 'a""' * 50_000 + '"'), None),
    ]
    got = reasons(spark, *(raw for raw, _ in cases))
    assert got == {i: reason for i, (_, reason) in enumerate(cases) if reason}


def test_loaded_and_rejected_split_the_records(spark):
    df = spark.createDataFrame([(1, GOOD), (1, "bad"), (2, GOOD), (None, GOOD), (None, "bad")], "raw_id long, raw string")
    loaded = rejects.strict_load(df)
    assert loaded.columns == ["raw_id", *rejects.FIELDS]
    assert sorted((r["raw_id"] or 0) for r in loaded.collect()) == [0, 1, 2]
    first = loaded.where("raw_id = 2").first()
    assert first["date_maj"] == dt.date(2024, 2, 29) and first["latitude"] == -2.0 and first["coordonnees_complement"] is None
    assert {(r["raw_id"], r["reason"]) for r in rejects.rejected(df).collect()} == {(1, "column_count"), (None, "column_count")}
    assert rejects.rejected(df.limit(0)).count() == 0 and rejects.strict_load(df.limit(0)).count() == 0


def point(x, y):
    return f"SRID=4326;POINT({x} {y})"


def test_containment_by_parity(spark):
    regions = spark.createDataFrame(
        [
            ("sq", "SRID=4326;POLYGON((0 40,1 40,1 41,0 41,0 40),(0.4 40.4,0.6 40.4,0.6 40.6,0.4 40.6,0.4 40.4))"),
            ("sq", "SRID=4326;POLYGON((0 40,1 40,1 41,0 41,0 40),(0.4 40.4,0.6 40.4,0.6 40.6,0.4 40.6,0.4 40.4))"),
            ("two", "MULTIPOLYGON (((2 40, 3 40, 3 41, 2 41)), ((4 40, 5 40, 4.5 41, 4 40)))"),
            ("none", "SRID=4326;MULTIPOLYGON EMPTY"),
            ("null", None),
        ],
        "code string, geom string",
    )
    rows = [
        ("in", point(0.2, 40.2)), ("hole", point(0.5, 40.5)), ("edge", point(0, 40.5)), ("vertex", point(1, 41)),
        ("hole edge", point(0.4, 40.5)), ("second", point(4.5, 40.5)), ("between", point(3.5, 40.5)), ("out", point(9, 40)),
        ("zero", point(0, 0)), ("empty", "SRID=4326;POINT EMPTY"), ("null", None), ("odd", "srid=4326; Point ( 2.5   40.5 )"),
    ]
    points = proximity.located(spark.createDataFrame(rows, "id string, geom string"), F.col("id"))
    inside = points.join(proximity.containing_regions(points, regions), ["lon", "lat"])
    got = sorted((r["key"], r["code"]) for r in inside.collect())
    assert got == sorted([("in", "sq"), ("edge", "sq"), ("vertex", "sq"), ("hole edge", "sq"), ("second", "two"), ("odd", "two")])
    assert proximity.containing_regions(points, regions.limit(0)).count() == 0
    assert proximity.containing_regions(points.limit(0), regions).count() == 0


def test_near_pairs_match_brute_force(spark):
    import math
    import random

    rng = random.Random(3)
    spots = [(i, 179.9995 + rng.uniform(-0.004, 0.004), rng.choice([0, 45, 70]) + rng.uniform(-0.004, 0.004)) for i in range(300)]
    spots = [(i, x - 360 if x > 180 else x, y) for i, x, y in spots]
    df = spark.createDataFrame(spots, "key int, lon double, lat double")
    got = {(r["left_key"], r["right_key"]) for r in proximity.near_pairs(df, df, 150.0).collect()}

    def metres(a, b):
        (_, x1, y1), (_, x2, y2) = a, b
        h = math.sin(math.radians(y2 - y1) / 2) ** 2
        h += math.cos(math.radians(y1)) * math.cos(math.radians(y2)) * math.sin(math.radians(x2 - x1) / 2) ** 2
        return 2 * 6_371_000 * math.asin(min(1, math.sqrt(h)))

    assert got == {(a[0], b[0]) for a in spots for b in spots if metres(a, b) <= 150}


def diff(spark, rows, **kw):
    df = spark.createDataFrame(rows, "n int, id string, v string, at timestamp")
    out = snapshots.snapshot_changes(df, "n", "id", [snapshots.careless_text(F.col("v"))], **kw)
    return sorted((r["record_key"], r["snapshot_no"], r["change_kind"]) for r in out.collect())


def test_snapshot_changes(spark):
    t = [dt.datetime(2026, 1, d) for d in range(1, 9)]
    rows = [
        (1, "a", "X  y", t[0]), (3, "a", " x Y", t[0]), (4, "a", "x z", t[0]),
        (1, "b", "old", t[0]), (1, "b", "new", t[1]), (3, "b", "new", t[0]),
        (1, "c", None, t[0]), (3, "c", "", t[0]),
        (3, "d", "1", t[0]), (3, None, "1", t[0]), (None, "e", "1", t[0]), (4, "é", "É", t[0]),
    ]
    expected = [("a", 4, "changed"), ("b", 4, "removed"), ("c", 4, "removed"), ("d", 3, "added"), ("d", 4, "removed"), ("é", 4, "added")]
    assert diff(spark, rows, order="at") == expected
    assert diff(spark, rows, order="at", rows_per_bucket=2) == expected
    assert diff(spark, rows[::-1] + rows, order="at") == expected
    assert diff(spark, [], order="at") == []


def test_change_values(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (2, "b", "z")], "n int, id string, v string")
    changes = snapshots.snapshot_changes(df, "n", "id", [F.col("v")])
    got = {r["record_key"]: (r["before"], r["after"]) for r in snapshots.change_values(df, changes, "n", "id", ["v"]).collect()}
    assert got == {"a": ('{"v":"x"}', '{"v":"y"}'), "b": (None, '{"v":"z"}')}
