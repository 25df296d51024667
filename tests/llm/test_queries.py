"""The training-data queries over the smallest tables: columns, keys, and SQL where there is any."""

import duckdb
import pytest

from bocage.llm import queries

FOUND = {"p1_found": ["etab_finess", "siret"], "p4_found": ["id", "siren"], "p7_found": ["id", "etab_finess"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name]
        assert len(set(rows)) == len(rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW dvf_mutations AS SELECT * FROM read_parquet('{sf_dir}/dvf_mutations.parquet')")
    df = queries.QUERIES[name](spark, sf_dir)
    columns = df.columns
    key = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, map(key, wanted))) == sorted(str(key(tuple(r))) for r in df.collect())


@pytest.mark.parametrize("name", ["p3_percentiles", "p3_from_days", "p3_daily"])
def test_percentiles_equal_the_sql_to_the_last_digit(spark, tmp_path, name):
    pairs = [
        (3448.425721, 3901.669943), (6484.408252, 6521.480082), (3843.385571, 4402.738933), (505.058642, 1273.390479), (510.464216, 1375.687526),
        (3183.504527, 3553.325762), (8093.292486, 8665.081928), (6761.071287, 7058.694017), (1e305, 1.7e308), (5e-324, 2e-7), (9007199254740993.0, 3e16),
    ]
    values = ", ".join(f"('{i}-{v}', 'c{i}', {v!r}::DOUBLE, TIMESTAMP '2026-01-01')" for i, p in enumerate(pairs) for v in p)
    con = duckdb.connect()
    con.execute(f"CREATE TABLE dvf_mutations AS SELECT * FROM (VALUES {values}) t(id_mutation, code_commune, prix_m2, loaded_at)")
    con.execute(f"COPY dvf_mutations TO '{tmp_path}/dvf_mutations.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    wanted = con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(wanted) == sorted(map(tuple, df.collect()))


def test_matches_are_one_to_one(spark, sf_dir):
    links = queries.p1_found(spark, sf_dir).collect()
    assert len({r["etab_finess"] for r in links}) == len({r["siret"] for r in links}) == len(links)


def test_the_combined_percentiles_are_the_judged_query():
    assert next(name for name in queries.QUERIES if name.startswith("p3_")) == "p3_percentiles"
