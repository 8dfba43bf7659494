import os

import pytest
from pyspark.sql import functions as F

from scoreloom import session
from scoreloom.params import ScoringParams
from scoreloom.plans import runs
from scoreloom.sources import readers, sinks


def test_from_parameters_to_files_and_back(spark, tmp_path):
    main = spark.range(1500).select(
        "id", (F.col("id") % 50).alias("cust"), ((F.col("id") * 7) % 90).alias("a"), ((F.col("id") * 11) % 40 + 1).alias("b"),
        F.concat(F.lit("2020-0"), F.col("id") % 6 + 1).alias("obs"),
        ((F.col("id") * 7) % 90 + F.pmod(F.hash("id"), F.lit(300)) > 190).cast("int").alias("y"),
    )
    main.write.parquet(f"{tmp_path}/main")
    side = spark.range(100).select((F.col("id") % 50).alias("cust"), (F.col("id") * 3 % 17).alias("paid"))
    side.write.parquet(f"{tmp_path}/payments")
    other = spark.range(50).select(F.col("id").alias("cust"), (F.col("id") % 5).alias("visits"))
    other.coalesce(1).write.option("header", True).csv(f"{tmp_path}/visits.csv")
    params = ScoringParams.from_dict(
        {
            "criterion_column": "y", "observation_date_column": "obs", "columns_to_exclude": ["obs", "cust"],
            "t1df": "2020-04", "t2df": "2020-05", "t3df": "2020-06", "main_table": f"{tmp_path}/main",
            "additional_tables": {f"{tmp_path}/payments": ["cust"], f"{tmp_path}/visits.csv": ["cust"]},
        }
    )
    folder, bucket = f"{tmp_path}/run", F.col("id") * 7919
    prepared = runs.prepare_run(spark, params, ["id"], folder, bucket)
    assert sinks.read_prepared(spark, f"{folder}/full").count() == 1500
    assert sinks.read_feature_list(spark, f"{folder}/features") == prepared.features
    full = sinks.read_prepared(spark, f"{folder}/full").columns
    assert any("paid" in c for c in full) and any("visits" in c for c in full)
    trained = runs.train_run(spark, params, ["id"], folder, ["dt"], bucket)
    assert spark.read.option("header", True).csv(f"{folder}/metrics").count() == trained.metrics.count()
    new = readers.load_table(spark, params.main_table).drop("y")
    result = runs.predict_run(spark, params, new, folder, ["dt"], f"{folder}/predictions", ["id"])
    written = spark.read.option("header", True).csv(f"{folder}/predictions")
    assert written.count() == 1500 and set(written.columns) == {"id", "predict_dt"}
    assert result.drift is not None


def test_tables_of_a_block_are_freed(spark):
    shared = session.shared_folder(spark)
    before = set(os.listdir(shared))
    with session.freed_tables(spark):
        stored = session.materialize(spark.range(5))
        assert stored.count() == 5 and set(os.listdir(shared)) != before
    assert set(os.listdir(shared)) == before


def test_hook_errors_are_told(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t")

    def hook(df):
        return df.select("not_there")

    assert readers.side_tables(spark, {"t": f"{tmp_path}/t"}, hook)["t"].count() == 3
    with pytest.raises(Exception, match="not_there"):
        readers.side_tables(spark, {"t": f"{tmp_path}/t"}, hook, strict=True)


def test_folders_hold_few_files(spark, tmp_path):
    df = spark.range(0, 4000, 1, 16).select("id", (F.col("id") % 3).cast("string").alias("obs"))
    sinks.write_prepared(df, f"{tmp_path}/p", "obs")
    for period in ("0", "1", "2"):
        assert len([f for f in os.listdir(f"{tmp_path}/p/obs={period}") if f.endswith(".parquet")]) <= 2
