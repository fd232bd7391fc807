from tidemark.sources import catalog


def test_create_append_list_drop(spark, tmp_path):
    name = catalog.create(spark, "Ann", "EUR/USD avg", 60, ["bid", "ask"], "quotes")
    assert name == "q_ann_eur_usd_avg_60" and catalog.exists(spark, "Ann", "EUR/USD avg", 60)
    rows = spark.sql("SELECT TIMESTAMP_NTZ'2024-01-01 00:00:00' AS value_time, TIMESTAMP_NTZ'2024-01-01 00:00:01' AS update_time, 1D AS tick_volume, 1.5D AS ask, 1.4D AS bid")
    catalog.append(spark, "Ann", "EUR/USD avg", 60, rows)
    assert spark.table(name).select("bid", "ask").first() == (1.4, 1.5)
    assert catalog.of_owner(spark, "ann") == [name]
    catalog.remove(spark, "Ann", "EUR/USD avg", 60)
    assert not catalog.exists(spark, "Ann", "EUR/USD avg", 60)
