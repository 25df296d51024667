"""Readers, the versioned store, the look-up source and streams."""

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from bocage.sources import files, registry
from bocage.sources.store import Store
from bocage.streaming import events


def test_delimited(spark, tmp_path):
    path = tmp_path / "a.csv.gz"
    with gzip.open(path, "wt", encoding="utf-8") as f:
        f.write('﻿id;nom;x\n1;"A ""b"" ; c";\n2;é;z\n')
    df = files.read_delimited(spark, str(path), columns=["id", "nom"], required=["x"])
    assert [tuple(r) for r in df.orderBy("id").collect()] == [("1", 'A "b" ; c'), ("2", "é")]
    with pytest.raises(ValueError, match="absent"):
        files.read_delimited(spark, str(path), required=["absent"])
    pipe = tmp_path / "b.txt"
    pipe.write_text('id|nom\n1|"as is\n')
    assert files.read_delimited(spark, str(pipe), sep="|", quote=None).first()["nom"] == '"as is'
    line = spark.createDataFrame([(';"x ""y""";z;',)], "v string")
    assert line.select(files.tokens(F.col("v")).alias("t")).first()["t"] == ["", 'x "y"', "z", ""]


def test_rows_of_another_shape_are_refused_or_set_apart(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("id;nom;x\n1;a;b\n2;short\n3;é;b;c;d\n".encode() + b"4;\xff\xfe;z\n5;ok;\n")
    for columns in (None, ["id"]):
        with pytest.raises(Exception, match="(?i)malformed|utf-8"):
            files.read_delimited(spark, str(path), columns=columns).collect()
    spoilt = tmp_path / "b.csv"
    spoilt.write_bytes(b"id;nom\n4;\xff\xfe\n")
    with pytest.raises(Exception, match="UTF-8"):
        files.read_delimited(spark, str(spoilt)).collect()
    good, rejects = files.read_with_rejects(spark, str(path))
    assert sorted(tuple(r) for r in good.collect()) == [("1", "a", "b"), ("5", "ok", "")]
    assert sorted((r["raw"][0], r["reason"]) for r in rejects.collect()) == [("2", "shape"), ("3", "shape"), ("4", "bytes")]


def test_sites(spark, tmp_path):
    def one(number, closed=None, commune="01001"):
        return {
            "informationsGeneralesEGE": {"numFinessEge": number, "nomEgeLong": " Centre\t X ", "dateOuverture": "2020-01-31", "dateFermeture": closed},
            "adresse": [{"usageAdresse": "01", "cogCommune": "0"}, {"usageAdresse": "03", "numeroVoie": "1", "typeVoie": "RUE", "libelleVoie": "X", "cogCommune": commune, "coordonneesGeographique": {"coordonneeX": "1.5", "coordonneeY": "44"}}],
            "contact": [{"telephone": " "}, {"telephone": "01 02 03"}],
        }

    (tmp_path / "s.json").write_text(json.dumps([one("010000001"), one("bad"), one("010000002", "2021-01-01"), one("010000003", commune="")]))
    got = {r["num_finess"]: r for r in files.read_sites(spark, str(tmp_path / "s.json")).collect()}
    good = got["010000001"]
    assert (good["name"], good["street"], good["commune"], good["lon"], good["phone"], good["opened"], good["skip_reason"]) == ("Centre X", "1 RUE X", "01001", 1.5, "010203", dt.date(2020, 1, 31), None)
    assert [got[k]["skip_reason"] for k in ("bad", "010000002", "010000003")] == ["bad_id", "closed", "no_commune"]
    entities = [{"sites": [one("010000001"), one("010000002")]}, {"sites": []}, {"sites": None}, {"sites": [one("010000004")]}]
    (tmp_path / "e.json").write_text("\n".join(map(json.dumps, entities)))
    nested = files.read_sites(spark, str(tmp_path / "e.json"), under="sites", lines=True)
    assert sorted(r["num_finess"] for r in nested.collect()) == ["010000001", "010000002", "010000004"]
    assert nested.columns == files.read_sites(spark, str(tmp_path / "s.json")).columns


def test_file_choice(spark, tmp_path):
    assert files.wanted_sales_files(["full-2024.csv.gz", "full-2024-s1.csv.gz", "full-2025-s1.csv.gz", "x"]) == ["full-2024.csv.gz", "full-2025-s1.csv.gz"]
    with pytest.raises(ValueError):
        files.wanted_sales_files(["full-2024-s1.csv.gz", "full-2024.csv.gz"])
    path = tmp_path / "f"
    path.write_bytes(b"PKxyz")
    files.precheck(spark, str(path), 5, b"PK")
    with pytest.raises(ValueError):
        files.precheck(spark, str(path), 6)
    with pytest.raises(ValueError):
        files.precheck(spark, str(path), 1, b"7z")
    assert files.fresh(spark, str(path), 60) and not files.fresh(spark, str(path), 60, now=path.stat().st_mtime + 61)
    assert len(files.file_digest(spark, str(path))) == 64


def test_store(spark, tmp_path):
    store = Store(str(tmp_path))
    with pytest.raises(LookupError):
        store.read(spark, "t")
    with pytest.raises(ValueError):
        store.stage(spark.range(1), "../t")
    assert store.drop_stale(spark, "t", 1, dt.datetime.now(dt.UTC)) == "absent"
    for n in (3, 5):
        store.publish(spark, "t", store.stage(spark.range(n), "t", sort=("id",)))
    assert store.read(spark, "t").count() == 5 and store.read(spark, "t", "previous").count() == 3
    store.rollback(spark, "t")
    assert store.read(spark, "t").count() == 3
    assert store.drop_stale(spark, "t", 1, dt.datetime.now(dt.UTC)) == "kept"
    assert store.drop_stale(spark, "t", 1, dt.datetime.now(dt.UTC) + dt.timedelta(days=2)) == "dropped"
    assert store.drop_stale(spark, "t", 1, dt.datetime.now(dt.UTC)) == "no_history"
    assert store.runs(spark).count() == 0
    store.log(spark, source="t", status="success", digest="abc", finished_at=dt.datetime(2026, 1, 1))
    assert store.unchanged(spark, "t", "abc") and not store.unchanged(spark, "t", "other") and not store.unchanged(spark, "u", "abc")


def test_lookup_source(spark, tmp_path):
    (tmp_path / "a.csv").write_text("code,name\n1,A\n2,\n")
    (tmp_path / "b.csv").write_text("name,code\nC,3\n")
    registry.register(spark)
    df = spark.read.format("bocage_lookup").schema("code string, name string").option("path", str(tmp_path)).load()
    assert sorted(tuple(r) for r in df.collect()) == [("1", "A"), ("2", None), ("3", "C")]


def test_commune_search(spark):
    df = spark.createDataFrame([("1", "Saint-Jean", 10, ["01100"], 1.0, 44.0), ("2", "Saint-Jean-Bas", 99, ["01200"], 2.0, 45.0)], "code_insee string, nom string, population long, codes_postaux array<string>, lon double, lat double")
    assert [r["code_insee"] for r in registry.find_communes(df, "ST JEAN").collect()] == ["1", "2"]
    assert [r["code_insee"] for r in registry.find_communes(df, "01200").collect()] == ["2"]
    assert registry.nearest_commune(df, 2.1, 45.1).first()["code_insee"] == "2"


def test_streams_match_batch(spark, tmp_path):
    t = lambda h: dt.datetime(2026, 1, 1 + h // 24, h % 24)
    data = [(i % 30, t(i % 40), i % 3, "ab"[i % 2], float(i), None) for i in range(60)]
    df = spark.createDataFrame(data, events.EVENTS)
    folder = str(tmp_path / "in")
    df.repartition(3).write.parquet(folder)
    stream = events.event_stream(spark, folder)
    got = events.run_available(events.windowed_counts(stream, "1 day"), str(tmp_path / "c1"), "complete").collect()
    batch = events.windowed_counts(df, "1 day").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, batch))
    updated = events.run_available(events.windowed_counts(events.event_stream(spark, folder, 1), "1 day"), str(tmp_path / "c3"), "update", ["start", "event_type"])
    assert sorted(map(tuple, updated.collect())) == sorted(map(tuple, batch))
    unique = events.run_available(events.once(events.event_stream(spark, folder), delay="30 days"), str(tmp_path / "c2"))
    assert unique.select("event_id").distinct().count() == unique.count() == 30
    assert events.sessions(df, "90 minutes").agg(F.sum("n")).first()[0] == 60
