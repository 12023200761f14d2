"""Every query of the engine's own operators against its SQL twin."""

import duckdb
import pytest

from loupe import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    return str(v)


def rows_of(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    if name in catalog.oracles():
        want = duck.sql(catalog.oracles()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert rows_of(got, df.columns) == rows_of(want.fetchall(), want.columns)
    else:
        assert got


def test_flagship(spark, sf_dir):
    rows = catalog.flagship(spark, sf_dir).collect()
    assert {r["category"] for r in rows} == {"invisible_unicode", "suspicious_unicode", "explicit_ai_attribution"}


def test_the_library_stands_without_the_corpus_operators():
    from pathlib import Path

    for p in (Path(__file__).parent.parent / "loupe").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
