import duckdb
import pytest

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def _plain(v):
    return round(v, 6) if isinstance(v, float) else v


def names():
    from tidewell.plans import library

    return sorted(library.QUERIES)


@pytest.mark.parametrize("name", names())
def test_query_equals_its_sql(spark, name):
    from tidewell.plans import library as queries

    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted([repr([_plain(r[c]) for c in columns]) for r in df.collect()])
    if name not in queries.SQL:
        return
    with duckdb.connect() as db:
        for t in TABLES:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        result = db.execute(queries.SQL[name])
        held = [d[0] for d in result.description]
        assert sorted(held) == columns
        at = [held.index(c) for c in columns]
        assert sorted(repr([_plain(r[k]) for k in at]) for r in result.fetchall()) == rows


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_id", "rank", "id", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
