"""Percentiles, packing, mixing and encodings: exact answers, round trips, edge cases."""

import datetime as dt
import math
import random
from collections import Counter

import numpy as np
import pytest

from bocage.llm import encoding, mixing, packing, percentiles, tokens

DVF = "id string, code string, prix double, loaded timestamp, `odd.name` string, g string"


def sales(spark):
    rng = random.Random(5)
    rows = []
    for code, n in (("hot", 4000), ("small", 7), ("one", 1), ("ties", 300)):
        for i in range(n):
            price = 100.0 if code == "ties" else round(rng.lognormvariate(7, 1), 2)
            rows.append((f"{code}{i}", code, price, dt.datetime(2026, 1, 1 + i % 9), None, "clash"))
    again = [(*r[:3], r[3] + dt.timedelta(days=3), *r[4:]) for r in rows[:500]]
    bad = [("n", c, p, dt.datetime(2026, 1, 1), None, "") for c, p in (("small", math.nan), ("small", math.inf), ("small", 0.0), ("small", -5.0), ("bad", None), (None, 3.0))]
    return rows, spark.createDataFrame(rows + again + bad, DVF)


def test_daily_runs_combine(spark):
    rows, df = sales(spark)
    daily = percentiles.kept_runs(df, "code", "prix", "loaded", run_values=100, by_day=True)
    early, late = daily.where("day < '2026-01-05'"), daily.where("day >= '2026-01-05'")
    runs = percentiles.merged(early.unionByName(late), run_values=500)
    assert runs.count() < daily.count()
    for r in percentiles.percentiles(runs, (0.0, 0.1, 0.5, 1.0)).collect():
        values = [v for _, c, v, *_ in rows if c == r["g"]]
        assert r["n"] == len(values)
        assert np.allclose([r["p00"], r["p10"], r["p50"], r["p100"]], np.percentile(values, [0, 10, 50, 100]), rtol=1e-12)


def test_every_percentile_query_selects(spark, sf_dir, monkeypatch):
    from bocage.llm import queries

    calls, select = [], percentiles.multi_select
    monkeypatch.setattr(percentiles, "multi_select", lambda *a: calls.append(1) or select(*a))
    for name in ("p3_percentiles", "p3_from_days", "p3_daily"):
        queries.QUERIES[name](spark, sf_dir)
    assert len(calls) == 3


@pytest.mark.parametrize("by_day", [False, True])
def test_multi_select_is_exact(spark, by_day):
    rows, df = sales(spark)
    runs = percentiles.kept_runs(df, "code", "prix", "loaded", run_values=100, by_day=by_day)
    got = {r["g"]: r for r in percentiles.percentiles(runs).collect()}
    assert set(got) == {"hot", "small", "one", "ties"}
    for code, r in got.items():
        values = [v for _, c, v, *_ in rows if c == code]
        assert r["n"] == len(values)
        assert np.allclose([r["p25"], r["p50"], r["p75"]], np.percentile(values, [25, 50, 75]), rtol=1e-12)


def test_sketches_combine_within_their_error(spark):
    rows, df = sales(spark)
    sketches = percentiles.day_sketches(percentiles.clean_values(df, "code", "prix", "loaded"))
    early, late = sketches.where("day < '2026-01-05'"), sketches.where("day >= '2026-01-05'")
    for r in percentiles.from_sketches(early.union(late)).collect():
        values = sorted(v for _, c, v, *_ in rows if c == r["g"])
        for q, p in ((0.25, r["p25"]), (0.5, r["p50"]), (0.75, r["p75"])):
            exact = values[math.floor(q * (len(values) - 1))]
            assert abs(p - exact) <= 1.0001 * percentiles.RELATIVE_ERROR * exact


def test_percentiles_of_nothing(spark):
    _, df = sales(spark)
    assert percentiles.percentiles(percentiles.kept_runs(df.limit(0), "code", "prix", "loaded")).count() == 0


def lengths(spark, sizes):
    return spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n_tokens long")


def test_packing_keeps_every_token(spark):
    rng = random.Random(2)
    sizes = [min(5000, int(rng.lognormvariate(5, 1.2))) for _ in range(3000)] + [0, 0, 10_000]
    kinds = spark.createDataFrame([("a", 256), ("b", 1024), ("b", 1024), ("c", 4096), ("bad", None), ("worse", 0)], "conteneur string, capacite_tokens int")
    layout = packing.layouts(lengths(spark, sizes), kinds, texts_per_shard=1000).toPandas()
    assert set(layout["conteneur"]) == {"a", "b", "c"}
    for kind, capacity in (("a", 256), ("b", 1024), ("c", 4096)):
        mine = layout[layout["conteneur"] == kind]
        assert mine.groupby("container_id")["n_tokens"].sum().max() <= capacity
        assert mine.groupby("doc_id")["n_tokens"].sum().to_dict() == {i: n for i, n in enumerate(sizes) if n}
        cut = set(mine.loc[mine["part"] > 0, "doc_id"])
        assert cut == {i for i, n in enumerate(sizes) if n > capacity}
        used = mine["n_tokens"].sum() / (mine["container_id"].nunique() * capacity)
        assert used > 0.97
    assert packing.layouts(lengths(spark, [5]).limit(0), kinds).count() == 0
    assert packing.layouts(lengths(spark, [5]), kinds.limit(0)).count() == 0


def test_pack_by_tiers():
    containers, tiers = packing.pack([10, 6, 4, 3, 3, 2, 1, 1], 10, [4, 10])
    assert sorted(i for c in containers for i in c) == list(range(8))
    assert len(containers) == 3 and tiers == [10, 10, 4, 4, 4, 4, 4, 4]
    assert packing.split_parts([0, 5, 25], 10) == [(1, 0, 0, 5), (2, 0, 0, 10), (2, 1, 10, 10), (2, 2, 20, 5)]
    assert packing.tier_sizes(1000, 3) == [250, 500, 1000] and packing.tier_sizes(1, 3) == [1]


def test_tiers_change_the_containers_and_keep_them_full():
    rng = random.Random(8)
    sizes = [min(2048, int(rng.lognormvariate(5, 1.1)) + 1) for _ in range(4000)]
    tiered, _ = packing.pack(sizes, 2048, packing.tier_sizes(2048))
    plain, _ = packing.pack(sizes, 2048, [2048])
    assert {frozenset(c) for c in tiered} != {frozenset(c) for c in plain}
    assert len(tiered) <= len(plain) * 1.01
    assert max(sum(sizes[i] for i in c) for c in tiered) <= 2048
    # Texts of one tier lie in windows of that tier: four texts of 300 share a container with its 512-token windows filled up.
    windows, tiers = packing.pack([300] * 4 + [212] * 4, 2048, [256, 512, 2048])
    assert len(windows) == 1 and tiers == [512] * 4 + [256] * 4


def test_steps_are_balanced_across_shards(spark):
    rng = random.Random(9)
    kinds = spark.createDataFrame([("a", 512)], "conteneur string, capacite_tokens int")
    layout = packing.layouts(lengths(spark, [rng.randint(1, 400) for _ in range(3000)]), kinds, texts_per_shard=400)
    row = packing.step_balance(layout).first()
    assert row["most_containers"] - row["least_containers"] <= 1
    assert row["most_tokens"] - row["least_tokens"] <= 2 * 512
    assert layout.select("container_id", "step_group").distinct().count() == layout.select("container_id").distinct().count()


def corpus(spark, sources):
    rng = random.Random(4)
    rows, i = [], 0
    for s, n in sources.items():
        for _ in range(n):
            rows.append((i, s, rng.randint(5, 300)))
            i += 1
    rows += [(i, None, 50), (i + 1, "untargeted", 50), (None, "a", 50), (i + 2, "a", 0)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


TARGETS = "source string, part_cible double, repetitions_max int"


def test_mixing_meets_targets(spark):
    docs = corpus(spark, {"a": 3000, "b": 400, "c": 60})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("b", 0.3, 3), ("c", 0.1, 20), ("none", 0.1, 2), ("off", None, 1), (None, 0.1, 1)], TARGETS)
    mixed = mixing.mix(docs, targets).cache()
    report = {r["source"]: r for r in mixing.shares(mixed, targets).collect()}
    for s, w in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(report[s]["part_reelle"] - w / 0.9) < 0.02, report[s]
        assert report[s]["most_repetitions"] <= report[s]["repetitions_max"]
    assert report["none"]["part_reelle"] == 0 and report["off"]["n_tokens"] == 0
    most = mixed.groupBy("doc_id", "source").count().groupBy("source").max("count").collect()
    assert all(r[1] <= report[r[0]]["repetitions_max"] for r in most)
    again = mixing.mix(docs, targets)
    assert again.exceptAll(mixed).count() == 0
    assert mixing.mix(docs.limit(0), targets).count() == 0 and mixing.mix(docs, targets.limit(0)).count() == 0


def test_mixing_of_very_many_sources(spark):
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('s', id % 15000) AS source", "200 + id % 7 AS n_tokens")
    targets = spark.range(15_000).selectExpr("concat('s', id) AS source", "1.0 / 15000 AS part_cible", "3 AS repetitions_max")
    mixed = mixing.mix(docs, targets.selectExpr("source", "cast(part_cible as double) part_cible", "cast(repetitions_max as int) repetitions_max"))
    row = mixed.agg({"repetition": "max", "source": "count"}).first()
    assert row["max(repetition)"] <= 3 and row["count(source)"] > 15_000


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    docs = corpus(spark, {"a": 800, "b": 200})
    targets = spark.createDataFrame([("a", 0.6, 1), ("b", 0.4, 9)], TARGETS)
    whole = {tuple(r) for r in mixing.mix(docs, targets).collect()}
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 37)
    assert {tuple(r) for r in mixing.mix(docs, targets).collect()} == whole


def test_token_counts(spark):
    df = spark.createDataFrame([(1, "Bonjour le monde"), (2, None), (3, ""), (4, "é" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in tokens.with_token_counts(df, ["doc_id"]).collect()}
    assert got[1] >= 3 and got[2] == 0 and got[3] == 0 and got[4] > 1000


CLEAN = [
    "Près de l’église, l'été dernier, la mairie a relevé 12 € d'écart à vérifier.",
    "Le répertoire a été mis à jour ; la qualité des données reste à améliorer.",
    "À défaut, l'établissement est fermé dès le 3 août, côté cour.",
    "Il a vérifié près de 40 % des fiches périmées, où qu'elles soient.",
]
FOREIGN = ["JOÃO et ÂNGELA ont relu. INFORMAÇÃO: A AVALIAÇÃO NÃO INCLUI A REGIÃO.", "русский, ελληνικά, Türkçe", "√2 et ∑ ; &eacute;tablissement &amp; site", "Ñandú, Õmnéa®"]


def test_encodings_are_found_and_undone(spark):
    rows = [(i, CLEAN[i % 4] + f" Dossier {i}.") for i in range(400)] + [(400 + i, FOREIGN[i % 4]) for i in range(40)]
    truth, n = {}, 1000
    for written, read in (("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp437"), ("utf-8", "mac_roman"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp437")):
        text = CLEAN[0] + " " + CLEAN[2]
        rows.append((n, encoding.damage_text(text, written, read)))
        truth[n] = text
        n += 1
    twice = encoding.damage_text(encoding.damage_text(CLEAN[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    rows += [(n, twice), (n + 1, "La qualit� reste � voir."), (n + 2, CLEAN[1] + " " + encoding.damage_text(CLEAN[3], "utf-8", "cp1252"))]
    truth |= {n: CLEAN[1], n + 2: CLEAN[1] + " " + CLEAN[3]}
    rows += [(5000, None), (5001, ""), (5002, "ascii only"), (None, "Ã©tÃ©"), (5003, (CLEAN[1] + " ") * 2000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in encoding.repaired(df).collect()}
    assert set(got) == {*truth, n + 1}
    assert {k: got[k]["restored"] for k in truth} == truth
    assert all(got[k]["restorable"] for k in truth) and not got[n + 1]["restorable"]
    assert encoding.repaired(df.limit(0)).count() == 0


def test_contexts_beyond_the_model_still_count_by_class(spark, monkeypatch):
    monkeypatch.setattr(encoding, "MODEL_SIZE", 2)
    rows = [("éa", "é", "b", 9), ("*", "é", "B", 8), ("_", "ñ", "z", 1), ("Q", "ñ", "*", 2)]
    counted = spark.createDataFrame([(left[-1], *more) for left, *more in rows], "left string, c string, right string, n long")
    model = encoding.Model(encoding._train(counted))
    assert len(model.fine) == 2 and model.total == 20 and model.alone["ñ"] == 3
    assert model.coarse["_ña"] == 1 and model.coarse["Añ*"] == 2 and model.coarse["*éA"] == 8


def test_layout_of_many_kinds(spark):
    kinds = spark.createDataFrame([(f"k{i}", 10 + i) for i in range(1100)], "conteneur string, capacite_tokens long")
    lengths = spark.createDataFrame([(1, 5)], "doc_id long, n_tokens long").limit(1)
    assert packing.layouts(lengths, kinds).select("conteneur").distinct().count() == 1100
