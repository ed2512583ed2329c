"""Every registered query of the package runs; those with SQL agree with it."""

import math

import duckdb
import pytest

from arborlake import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    found = duck.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in found.fetchall())


def test_semantic_mappings_of_counts_that_cancel(spark, tmp_path):
    # "io" and "rd" cancel in a bucket of the phrase's words, "ench" and "geö" in another one
    texts = ["Io rd.\nthe region of the nation", "Ench geö.\nof the\nanother region", "io rd io"]
    made = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    made.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    wanted = sorted(tuple(map(plain, r)) for r in con.execute(catalog.oracle_sql()["semantic_mappings"]).fetchall())
    found = sorted(tuple(map(plain, r)) for r in catalog.queries()["semantic_mappings"](spark, str(tmp_path)).collect())
    assert found == wanted and ("0#0", "place", "nan", "semantic:0") in wanted and all(k != "1#0" for k, *_ in wanted)


def test_flagship(spark, sf_dir):
    assert catalog.flagship(spark, sf_dir).count() == 20


def test_csv_whole_table(spark):
    found = catalog.queries()["csv_cells"](spark, "/root/testdata/sf0.1").where("col = 0")
    customers = spark.read.parquet("/root/testdata/sf0.1/customer.parquet")
    assert sorted(int(r["value"]) for r in found.collect()) == sorted(r["c_custkey"] for r in customers.collect())


def test_markdown_whole_table(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")
    wanted = sorted(r["conv_id"] for r in conversations.select("conv_id").distinct().collect())
    assert wanted[-1] >= 200
    for name in ("markdown_elements", "markdown_front_matter"):
        found = catalog.queries()[name](spark, "/root/testdata/sf0.1").select("doc_id").distinct()
        assert sorted(r["doc_id"] for r in found.collect()) == wanted
