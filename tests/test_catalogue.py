import duckdb
import pytest

from ledgerline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(round(r[i], 6) + 0.0 if isinstance(r[i], float) else r[i] for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    df = catalogue.queries()[name](spark, SF)
    got = _rows([tuple(r) for r in df.collect()], df.columns)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(sql)
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(cur.fetchall(), columns)


def test_names_resolve_by_the_whole_lexicon(spark):
    got = catalogue.queries()["fuzzy_weighted_ratio"](spark, SF).filter("p_partkey % 3 = 0").collect()
    assert got and all(r["resolved"] == r["probe"] and r["score"] == 100 for r in got)


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
