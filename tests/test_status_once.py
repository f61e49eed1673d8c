import __spark_entry__ as entry


def test_calculations_read_one_written_table_of_facts(spark):
    for name in ("calc_ratio", "calc_growth", "calc_cross_foot", "calc_replay"):
        files = entry.queries()[name](spark, "/root/testdata/sf0.001").inputFiles()
        assert files and not [f for f in files if "orders" in f or "customer" in f]
