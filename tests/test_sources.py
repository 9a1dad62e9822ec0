import pytest
from pyspark.sql import functions as F

from barweave.session import shared_dir, workspace
from barweave.sources import store as S


@pytest.fixture
def bars(spark):
    n = F.col("id").cast("double") + 1
    return spark.range(30).select(
        F.when(F.col("id") % 3 == 0, "BRK.B").otherwise("^GSPC").alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("dt"),
        *[n.alias(c) for c in ("open", "high", "low", "close", "adj_close", "volume")],
    )


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_processed_layer_wins_and_writes_leave_others(spark, bars, fmt):
    root = workspace(spark, "t")
    S.write_bars(bars, root, "raw", "5y", fmt)
    S.write_bars(bars.filter("symbol = 'BRK.B'").withColumn("close", F.lit(7.0)), root, "processed", "5y", fmt)
    S.write_bars(bars.limit(2), root, "raw", "10y", fmt)
    got = S.read_bars(spark, root, fmt=fmt)
    assert got.count() == 30 and got.filter("symbol = 'BRK.B' and close <> 7").count() == 0
    assert S.read_bars(spark, root, ["^GSPC", "missing"], fmt=fmt).count() == 20
    assert S.dataset_inventory(spark, root, fmt).count() == S.stored_bars(spark, root, fmt).select("layer", "period", "symbol").distinct().count()
    plan = S.read_bars(spark, root, ["^GSPC"], fmt=fmt, start="2024-01-05")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan


def test_single_symbol_files(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    for s in ("AAA", "BBB"):
        (tmp_path / "raw" / f"{s}_5y_raw.csv").write_text("Date,Open,High,Low,Close,Adj Close,Volume\n2024-01-02,1,2,0.5,1.5,1.4,100\n2024-01-03,1,2,0.5,1.5,,\n")
    rows = S.read_symbol_files(spark, str(tmp_path)).orderBy("symbol", "dt").collect()
    assert [r["symbol"] for r in rows] == ["AAA", "AAA", "BBB", "BBB"]
    assert rows[0]["adj_close"] == 1.4 and rows[1]["volume"] is None


def test_checkpoint_dir_of_the_session_is_used(spark):
    assert workspace(spark, "x").startswith(shared_dir(spark))


def test_shared_folder_is_required_off_one_machine():
    from barweave.session import require_local

    require_local("local[4]")
    for master in ("local-cluster[3,2,1024]", "yarn", "k8s://https://x"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            require_local(master)
