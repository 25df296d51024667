"""Operators on small tables, against brute force where order or iteration matters."""

import random

import pytest
from pyspark.sql import functions as F

from bocage.operators import enrich, measures, quality, query
from bocage.operators.communes import with_commune
from bocage.plans import aggregates


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns or df.columns) for r in df.collect())


def test_argument_checks():
    for bad in ((0, 0), (501, 0), (1, -1), (1, 100_001)):
        with pytest.raises(ValueError):
            query.check_limit(*bad)
    for bad in ((181, 0, 1), (0, 91, 1), (0, 0, 0.05), (0, 0, 51)):
        with pytest.raises(ValueError):
            query.check_point(*bad)
    assert query.exactly_one(dept="01", insee=None) == "dept"
    with pytest.raises(ValueError):
        query.exactly_one(dept=None, insee=None)


def test_filters(spark):
    df = spark.createDataFrame([(1, "C", ["a"]), (2, None, ["b", "c"]), (3, "M", None)], "id int, k string, codes array<string>")
    assert rows(query.lenient_category(df, "k", []), "id") == [(1,), (2,)]
    assert rows(query.optional_in(df, "k", []), "id") == [(1,), (2,), (3,)]
    assert rows(query.overlapping(df, "codes", ["c", "z"]), "id") == [(2,)]
    wanted = spark.createDataFrame([("a",), ("z",)], "code string")
    known = df.select(F.explode("codes").alias("code"))
    assert rows(query.unknown_codes(wanted, known)) == [("z",)]
    assert query.unknown_codes(wanted, known.limit(0)).count() == 0
    with pytest.raises(LookupError):
        query.require_rows(df.limit(0), "table")


def test_hybrid_radius(spark):
    people = spark.createDataFrame(
        [(i, "t1" if i % 2 else "t2", 2.0 + i * 0.001, 48.0, i % 3 == 0) for i in range(1, 40)], "id long, town string, lon double, lat double, precise boolean"
    )
    towns = spark.createDataFrame([("t1", 2.0, 48.0), ("t2", 3.5, 48.0)], "town string, lon double, lat double")
    got = query.hybrid_radius(people, towns, "town", 2.0, 48.0, 5000.0, 10, "id").collect()
    assert len(got) == 10 and {r["precision"] for r in got} == {"centroid"}
    alone = query.hybrid_radius(people, towns, "town", 2.0, 48.0, 2000.0, 50, "id", precise_only=True)
    assert [r["id"] for r in alone.orderBy("distance_m").collect()] == [3, 6, 9, 12, 15, 18, 21, 24]


def test_truncated_and_top(spark):
    df = spark.range(10)
    assert rows(query.truncated(df, [F.col("id")], 3)) == [(0, True), (1, True), (2, True)]
    assert {r["truncated"] for r in query.truncated(df, [F.col("id")], 10).collect()} == {False}
    top = query.top_per_group(df.withColumn("g", F.col("id") % 2), ["g"], [F.desc("id")], 2)
    assert rows(top, "g", "id") == [(0, 6), (0, 8), (1, 7), (1, 9)]


def test_one_to_one_equals_greedy(spark):
    rng = random.Random(7)
    pairs = [(f"a{rng.randint(0, 12)}", f"b{rng.randint(0, 12)}", rng.choice([0.7, 0.8, 0.9])) for _ in range(120)]
    pairs = [(a, b, max(s for x, y, s in pairs if (x, y) == (a, b))) for a, b in sorted({p[:2] for p in pairs})]
    expected, used = [], set()
    for a, b, s in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        if a not in used and b not in used:
            used |= {a, b}
            expected.append((a, b, s))
    got = enrich.matched_one_to_one(spark.createDataFrame(pairs, "l string, r string, s double"), "l", "r", "s")
    assert rows(got) == sorted(expected)
    assert enrich.matched_one_to_one(spark.createDataFrame([], "l string, r string, s double"), "l", "r", "s").count() == 0


def test_one_to_one_of_a_hot_group(spark):
    keys = [f"{i:03}" for i in range(70)]
    pairs = [(f"a{i}", f"b{j}", 1.0) for i in keys for j in keys[:60]] + [(f"a{i}", "c", 0.9) for i in keys]
    got = enrich.matched_one_to_one(spark.createDataFrame(pairs, "l string, r string, s double"), "l", "r", "s")
    assert rows(got) == sorted([(f"a{i}", f"b{i}", 1.0) for i in keys[:60]] + [("a060", "c", 0.9)])


def test_one_to_one_of_groups(spark):
    rng = random.Random(3)
    lefts = sorted({(f"g{rng.randint(0, 9)}", i) for i in range(60) for _ in range(rng.choice([1, 1, 2]))})
    rights = sorted({(f"h{rng.randint(0, 9)}", i) for i in range(60) for _ in range(rng.choice([1, 1, 2]))})
    edges = {(f"g{rng.randint(0, 9)}", f"h{rng.randint(0, 9)}"): rng.choice([0.7, 0.8, 0.9]) for _ in range(16)}
    pairs = {}
    for (a, b), s in edges.items():
        for x in (k for g, k in lefts if g == a):
            for y in (k for h, k in rights if h == b):
                pairs[x, y] = max(s, pairs.get((x, y), 0))
    expected, gone, used = [], set(), set()
    for (x, y), s in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if x not in gone and y not in used:
            gone.add(x)
            used.add(y)
            expected.append((x, y, s))
    df = spark.createDataFrame
    got = enrich.matched_groups(
        df([(a, b, s) for (a, b), s in edges.items()], "a string, b string, s double"), df(lefts, "a string, x long"), df(rights, "b string, y long"), "x", "y", "s"
    )
    assert rows(got) == sorted(expected)


def test_upsert_and_carry_over(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, at int")
    changes = spark.createDataFrame([(2, "c", 2), (2, "d", 3), (3, "e", 1)], "k int, v string, at int")
    assert rows(enrich.upserted(base, changes, ["k"], "at"), "k", "v") == [(1, "a"), (2, "d"), (3, "e")]
    new = spark.createDataFrame([(1, None, "x"), (2, "own", "y"), (3, None, None)], "k int, g string, src string")
    old = spark.createDataFrame([(1, "was"), (2, "was")], "k int, g string")
    assert {r["k"]: (r["g"], r["src"]) for r in enrich.carried_over(new, old, "k", "g", "src", "previous").collect()} == {
        1: ("was", "previous"), 2: ("own", "y"), 3: (None, None),
    }


def test_carry_over_on_two_keys(spark):
    new = spark.createDataFrame([(1, "c", None, "x"), (2, "c", None, "y")], "k int, c string, g string, src string")
    old = spark.createDataFrame([(1, "c", "was"), (2, "other", "was")], "k int, c string, g string")
    got = enrich.carried_over(new, old, ["k", "c"], "g", "src", "previous")
    assert {r["k"]: (r["g"], r["src"]) for r in got.collect()} == {1: ("was", "previous"), 2: (None, "y")}


def test_practitioners_are_told_apart_by_title_and_type(spark, tmp_path):
    people = [("A", "B", "M", "01", "1", 1), ("A", "B", "MME", "01", "1", 2), ("A", "B", "M", "01", "2", 3), ("A", "B", "M", "01", "1", 4)]
    df = spark.createDataFrame(people, "nom string, prenom string, civilite string, specialite_code string, type_ps_code string, id long")
    df.write.parquet(str(tmp_path / "annuaire_ameli.parquet"))
    assert rows(aggregates.practitioners(spark, str(tmp_path)), "ids") == [("1,4",), ("2",), ("3",)]


def test_commune_cascade(spark):
    communes = spark.createDataFrame(
        [("01001", "Saint-Aubin", ["01100"], "01"), ("01002", "Belleville", ["01100", "01200"], "01"), ("02001", "Saint-Aubin", ["02100"], "02"), ("02002", "Unique", ["02300"], "02")],
        "code_insee string, nom string, codes_postaux array<string>, code_departement string",
    )
    cases = [("99x", None, None, None), ("01002", None, None, "01002"), (None, "02100", "ST AUBIN CEDEX", "02001"), (None, "01100", "Sant-Aubin", "01001"),
             (None, "01200", "?", "01002"), (None, "01100", "?", None), (None, None, "unique", "02002"), (None, None, "Saint Aubin", None), (None, "02999", "st-aubin", "02001")]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, code string, cp string, ville string")
    got = with_commune(df, communes, F.col("code"), F.col("cp"), F.col("ville"))
    assert {r["i"]: r["commune"] for r in got.collect()} == {i: c[3] for i, c in enumerate(cases)}
    assert got.columns == ["i", "code", "cp", "ville", "commune"]


def test_measures(spark):
    df = spark.createDataFrame([("a", 100, 20.0, 10), ("a", 300, None, 30), ("b", 0, 5.0, 0)], "k string, pop int, inc double, young int")
    got = {r["k"]: r for r in measures.weighted_profile(df, ["k"], "pop", "inc", ["young"]).collect()}
    assert (got["a"]["mean_income"], got["a"]["covered_pct"], got["a"]["share_young"]) == (20.0, 25.0, 0.1)
    assert got["b"]["mean_income"] is None and got["b"]["share_young"] is None
    counts = spark.createDataFrame([("a", 3), ("b", 1)], "k string, n long")
    pop = spark.createDataFrame([("a", 1000), ("b", 0)], "k string, population long")
    rates = {r["k"]: (r["rate"], r["gap_pct"]) for r in measures.rate_per(counts, pop, "k").collect()}
    assert rates == {"a": (300.0, -25.0), "b": (0.0, -100.0)}
    months = spark.createDataFrame([(m,) for m in [1] * 10 + [2] * 9 + [3] * 5 + [4] * 4], "m int")
    assert measures.published_month(months, F.col("m")).first()["month"] == 3


def test_quality(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    rules = [quality.Rule("rows", F.count("*"), 1, 10), quality.Rule("nulls", quality.rate(F.col("x").isNull()), None, 0.1, "warning")]
    assert quality.enforce(quality.evaluate(df, rules)) == ["nulls"]
    with pytest.raises(ValueError, match="rows"):
        quality.enforce(quality.evaluate(df, [quality.Rule("rows", F.count("*"), 4, None)]))
    assert [quality.relative_band(95, 100), quality.relative_band(50, 100), quality.relative_band(5, None)] == ["ok", "refused", "skipped"]
    assert {r["ok"] for r in quality.evaluate(df.limit(0), [quality.Rule("nulls", quality.rate(F.col("x").isNull()), None, 0.1)]).collect()} == {True}


def test_dice_join_loses_nothing(spark):
    import random

    from bocage.functions import text
    from bocage.operators import matching

    rng = random.Random(6)
    words = {"".join(rng.choice("abcd") for _ in range(rng.randint(0, 12))) for _ in range(220)} | {"aaaa", "aaaaa", "x"}
    df = spark.createDataFrame([(w,) for w in sorted(words)] + [(None,)], "w string")
    a, b = df.withColumnRenamed("w", "a"), df.withColumnRenamed("w", "b")
    every = a.join(b, F.lit(True)).where(text.dice(F.col("a"), F.col("b")) >= 0.6)
    got = {(r["a"], r["b"]) for r in matching.dice_join(a, "a", b, "b", 0.6).collect()}
    assert got == {(r["a"], r["b"]) for r in every.collect()} and len(got) > len(words)


def test_work_queue_gives_stale_rejections_one_more_try(spark):
    from bocage.operators import quality

    keys = spark.range(8).selectExpr("id AS k")
    cache = spark.createDataFrame([(0, True, 1, True), (1, False, 2, False), (2, False, 3, False), (3, False, 3, True), (4, False, 4, True)], "k long, accepted boolean, attempts int, old boolean")
    work = quality.work_selection(keys, cache, "k", stale=F.col("old"))
    assert {r["k"] for r in work.collect()} == {1, 3, 5, 6, 7}
    queue = quality.work_queue(work, "k", 4).collect()
    assert [(r["k"], r["attempts"], r["remaining"]) for r in sorted(queue, key=lambda r: (r["attempts"], r["k"]))] == [(5, 0, 1), (6, 0, 1), (7, 0, 1), (1, 2, 1)]


def test_profiles_and_sections_of_nothing(spark):
    import pytest

    from bocage.operators import profiles

    areas = spark.createDataFrame([("010010101", 1.0, 44.0, 100, 20, 30, None)], "code string, lon double, lat double, population long, young long, old long, income long")
    regions = spark.createDataFrame([("010010101", "POLYGON((0 43,2 43,2 45,0 45,0 43))")], "code string, geom string")
    assert profiles.area_profile(areas, regions, point=(1.0, 44.0)).first()["population"] == 100
    assert profiles.area_profile(areas, regions, point=(5.0, 44.0)).count() == 0
    assert profiles.area_profile(areas, regions, code="99").count() == 0
    assert profiles.area_profile(areas, regions, code="01001", radius_m=10.0).first()["n_areas"] == 1
    with pytest.raises(ValueError):
        profiles.area_profile(areas, regions)
    assert profiles.section(areas.limit(0), "x", 5).first()["status"] == "empty"
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 2)], "k string, v int")
    got = {r["k"]: (r["v"], r["n_rows"], r["several"]) for r in profiles.one_row_each(rows, "k", ids, ["v"]).collect()}
    assert got == {"a": (2, 2, True), "b": (None, 0, False)}


def test_exact_percentiles_hold_no_group_whole(spark, monkeypatch):
    import numpy as np

    from bocage.operators import measures

    monkeypatch.setattr(measures, "ACCURACY", 50)
    rng = random.Random(7)
    sizes = [("a", 3000), ("b", 5), ("c", 1), (None, 40), *((f"s{n}", n) for n in range(2, 130, 3))]
    rows = [(g, rng.choice((1.5, 7.0, rng.gauss(0, 9), rng.gauss(0, 9)))) for g, n in sizes for _ in range(n)] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = {f"q{i}": (F.col("v"), q) for i, q in enumerate((0.0, 0.25, 0.5, 0.99, 1.0))}
    for r in measures.exact_percentiles(df, ["g"], wanted).collect():
        values = [v for g, v in rows if g == r["g"] and v is not None]
        got = [r[n] for n in wanted]
        assert (got == [None] * 5) if not values else np.allclose(got, np.percentile(values, [0, 25, 50, 99, 100]), rtol=1e-12)
    assert measures.exact_percentiles(df.limit(0), [], wanted).count() == 0
