"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime
import decimal

import pytest

from loamstone.plans import graph_queries, memory_queries  # noqa: F401  (they register more queries)
from loamstone.plans.queries import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}" if v else "0"
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    found = QUERIES[name](spark, data)
    rows = sorted(str([plain(v) for v in r]) for r in found.collect())
    if name in ORACLE_SQL:
        columns = ", ".join(f'"{c}"' for c in found.columns)
        assert rows == sorted(str([plain(v) for v in r]) for r in con.sql(f"select {columns} from ({ORACLE_SQL[name]})").fetchall())
    elif name == "markdown_chunks":
        # every word once and in order, one section for each line with text, no chunk over the limit but by what is too small to stand alone
        chunks = {}
        for r in sorted(map(tuple, found.collect()), key=lambda r: r[:2]):
            chunks.setdefault(r[0], []).append(r)
        for i, source, text in con.sql("select doc_id, source, text from documents where text is not null and not contains(text, '#')").fetchall():
            own = chunks.pop(i, [])
            assert [r[1] for r in own] == list(range(len(own)))
            assert [w for _, _, title, body in own for line in body.split("\n") if line != f"# {title}" for w in line.split()] == text.split()
            first, *rest = text.split("\n")
            assert {r[2] for r in own} == ({source} if first.strip() else set()) | ({"part"} if any(x.strip() for x in rest) else set())
            assert all(len(r[3]) <= 4 * (512 + 2 * 64) for r in own)
        assert all("#" in (con.sql(f"select text from documents where doc_id = {i}").fetchall()[0][0] or "#") for i in chunks)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
