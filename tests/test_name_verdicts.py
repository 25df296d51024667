"""Verdicts of names: every pair is compared, none travels."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from bocage.functions import text
from bocage.operators import likeness, matching
from bocage.plans import matching as plans


def shuffled(spark):
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    none = spark.sparkContext._gateway.new_array(jvm.double, 0)
    stages = store.stageList(None, False, False, none, jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_names_of_one_form_shuffle_no_pairs(spark, tmp_path):
    rng = random.Random(4)
    name = lambda: "selarl cabinet de kinesitherapie du docteur " + "".join(rng.choice("aeiounrstl") for _ in range(9))
    rows = [(f"s{i}", f"c{i % 7}", name(), name()) for i in range(400)]
    df = spark.createDataFrame(rows, "siret string, code_commune string, enseigne string, raison_sociale_unite_legale string")
    df.write.parquet(f"{tmp_path}/sirene_etablissements.parquet")
    before = shuffled(spark)
    got = plans.name_verdicts(spark, str(tmp_path)).collect()
    assert len(got) == 400 and max(r["n_candidates"] for r in got) > 100
    assert shuffled(spark) - before < 15_000


def test_verdicts_of_split_communes_nulls_and_short_names(spark, monkeypatch):
    monkeypatch.setattr(likeness, "LEAST", 20)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.choice((0, 1, 2, 6, 7, 8))))
    sites = [(rng.choice((None, *map(str, range(90)))), rng.choice((None, "a", "a", "a", "b", *"cdefgh")), rng.choice((None, word(), word()))) for _ in range(400)]
    queries = [(word(),) for _ in range(80)] + [(None,), ("zzzz",)]
    q, s = spark.createDataFrame(queries, "query string"), spark.createDataFrame(sites, "siret string, commune string, name string")
    near = q.distinct().join(s, text.dice(F.col("query"), F.col("name")) >= 0.6).select("query", "siret", "commune").distinct().collect()
    wanted, towns = defaultdict(int), defaultdict(set)
    for query, _, commune in near:
        wanted[query] += 1
        towns[query] |= {commune} - {None}
    got = matching.name_verdict(q, s, 0.6).collect()
    assert {r["query"]: (r["n_candidates"], r["n_communes"]) for r in got} == {k: (n, len(towns[k])) for k, n in wanted.items()}
    for r in got:
        one = len(towns[r["query"]]) == 1
        assert r["commune"] == (min(towns[r["query"]]) if one else None)
        assert r["verdict"] == ("unique" if wanted[r["query"]] == 1 else "one_commune" if one else "several_communes")
    assert matching.name_verdict(q.limit(0), s, 0.6).count() == 0 and matching.name_verdict(q, s.limit(0), 0.6).count() == 0


def test_likeness_is_exact_beyond_its_bits():
    rng = random.Random(6)
    word = lambda: "".join(chr(0x4E00 + rng.randrange(900)) for _ in range(rng.randint(0, 5)))
    queries = [word() for _ in range(900)]
    names = [*(q[:-1] + "x" for q in queries), *queries[:40]]
    pairs = {(i, int(j)): s for i, found, scores in likeness.alike(queries, names, 0.5) for j, s in zip(found, scores)}
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    for i, a in enumerate(queries):
        for j, b in enumerate(names):
            size = max(len(a) - 1, 0) + max(len(b) - 1, 0)
            score = 1.0 if a == b else 2 * len(grams(a) & grams(b)) / size if min(len(a), len(b)) > 1 else 0.0
            assert pairs.get((i, j), 0.0) == (score if score >= 0.5 else 0.0), (a, b)
