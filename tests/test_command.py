import pytest

from ledgerline.__main__ import main
from ledgerline.sources import scans

SF = "/root/testdata/sf0.001"


def test_list_run_and_explain(spark, tmp_path, capsys):
    assert main(["list"]) == 0
    names = capsys.readouterr().out.split()
    assert "benchmark" in names and names == sorted(names) and len(names) > 150
    assert main(["run", "feed_snapshot", "--data", SF, "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    assert main(["run", "event_props", "--data", f"{SF}/", "--rows", "1"]) == 0 and main(["explain", "panel_keys", "--data", SF]) == 0
    assert "Physical Plan" in capsys.readouterr().out
    assert main(["run", "nothing", "--data", SF]) == 2
    with pytest.raises(SystemExit):
        main(["run", "benchmark"])


def test_a_table_that_is_not_there_is_empty(spark):
    assert scans.table_or_empty(spark, "no_such_table", "code long, delist_date date").count() == 0
    spark.range(3).createOrReplaceTempView("three_rows")
    assert scans.table_or_empty(spark, "three_rows", "id long").count() == 3
    spark.catalog.dropTempView("three_rows")
