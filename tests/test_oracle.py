"""Every view in both engines, and queries against their expected SQL."""

import math
from pathlib import Path

import duckdb
import pytest

import oracle
from loreweave import fixtures
from loreweave.queries import queries

DATA = "/root/testdata/sf0.001"
#: These repeat the whole onboarding; the ones left in the list below cover its steps.
LONG = {"spec_upsert", "spec_splice", "spec_prompts", "spec_tags", "spec_files", "spec_dependencies", "new_domains", "related_files", "regen_plan"}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return tuple(map(plain, value)) if isinstance(value, (list, tuple)) else value


def ordered(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", fixtures.VIEW_NAMES)
def test_views(spark, duck, name):
    text = fixtures.sql_text(name, "duckdb")
    got = fixtures.view(spark, DATA, name)
    want = duck.execute(text)
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert got.count() == len(want.fetchall()) > 0


def test_every_query_has_sql(duck):
    assert set(queries()) == set(oracle.QUERIES)
    for text in oracle.all_sql().values():
        duck.execute(f"explain {text}")


@pytest.mark.parametrize("key", [k for k in oracle.QUERIES if k not in LONG])
def test_rows(spark, duck, key):
    got = queries()[key](spark, DATA)
    names = sorted(got.columns)
    want = duck.execute(oracle.sql(key))
    own = [c[0] for c in want.description]
    assert names == sorted(own)
    want = [[r[own.index(n)] for n in names] for r in want.fetchall()]
    assert [tuple(map(str, r)) for r in ordered([r[n] for n in names] for r in got.collect())] == [tuple(map(str, r)) for r in ordered(want)]
