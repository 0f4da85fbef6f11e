import __spark_entry__ as entry


def test_entry_and_names(spark):
    rows = entry.entry(spark)
    assert rows.count() > 0 and rows.columns == ["x_bin", "y_bin", "transcript_count", "z_mean_um"]
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100


def test_some_queries_against_sql(spark):
    import duckdb

    con = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for t in ("lineitem", "part", "orders"):
        con.sql(f"create view {t} as from '{folder}/{t}.parquet'")
    for name in ("cell_agg", "raw_count", "cell_gene_counts", "bh_fdr", "read_marker_groups"):
        own = entry.queries()[name](spark, folder).toPandas()
        want = con.sql(entry.oracle_sql()[name]).df()
        columns = sorted(own.columns)
        assert columns == sorted(want.columns)
        assert sorted(map(repr, own[columns].values.tolist())) == sorted(map(repr, want[columns].values.tolist()))
