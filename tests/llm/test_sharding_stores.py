"""Sharding starts few processes beside the executors: one stored table, and no Python workers for the driver's plan."""

from ledgerlight.llm import sharding


def test_sharding_stores_its_rows_only_and_sends_the_plan_without_python(spark, documents, monkeypatch):
    labels, stored = [], sharding.stored
    monkeypatch.setattr(sharding, "stored", lambda df, label: labels.append(label) or stored(df, label))
    made = sharding.shard_documents(documents)
    assert labels == ["shard-rows"]
    assert "ExistingRDD" not in made._jdf.queryExecution().toString()
    assert made.count() == documents.count()
