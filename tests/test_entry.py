import __spark_entry__ as entry

from vacantia.plans import registry


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["source_table", "row_key", "normal_value"] and df.count() > 0
