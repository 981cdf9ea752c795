from cairnwork.plans import registry, texts  # noqa: F401

SF = "/root/testdata/sf0.01"


def test_all_customers_with_blanks_last(spark):
    rows = registry.QUERIES["L_04_all_blanks_last"](spark, SF).collect()
    assert len(rows) == spark.read.parquet(f"{SF}/customer.parquet").count()
    assert any(r.top is None for r in rows)
    assert rows == sorted(rows, key=lambda r: (r.top is None, -(r.top or 0), r.c_name, r.c_custkey))
