"""Texts and spans stored in one layout."""

import pytest
from pyspark.sql import functions as F

import velum
from velum.sources.store import read_store, write_store

CFG = velum.DeidConfig.from_dict(
    {"models": {"telephone": "regex", "date": "regex", "person": "stanza"}, "mask": {"mode": "tag"}}
)
RAW = "doc_id string, start int, end int, label string, text string, model string"


@pytest.fixture(scope="module")
def tables(spark):
    texts = [(f"d{k}", f"Aldo, nata il {1 + k % 28}/4/2020, tel 349 12345{k % 100:02d}") for k in range(200)]
    texts += [("empty", ""), ("null", None), (None, "tel 349 1234567")]
    raw = [(f"d{k}", 0, 4, "PER", "Aldo", "stanza") for k in range(0, 200, 2)] * 2
    docs = spark.createDataFrame(texts, "doc_id string, text string")
    found = velum.find_spans(docs, CFG, skip_models=("stanza",))
    return docs, found, spark.createDataFrame(raw, RAW)


@pytest.fixture(scope="module")
def store(spark, tables, tmp_path_factory):
    path = f"{tmp_path_factory.mktemp('store')}/it's a store"
    docs, found, raw = tables
    write_store(path, docs, 7, spans=found, reports=raw)
    return read_store(spark, path)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


@pytest.fixture(autouse=True)
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def rows(df):
    return sorted(map(str, df.collect()))


def test_round_trip(tables, store):
    assert set(store) == {"texts", "spans", "reports"}
    for kept, df in zip((store["texts"], store["spans"], store["reports"]), tables):
        assert kept.columns == df.columns and rows(kept) == rows(df)


def test_remask_without_exchange(tables, store):
    docs, found, _ = tables
    cfg = velum.DeidConfig.from_dict({"mask": {"mode": "tag"}})
    plain = velum.remask(docs, found, cfg)
    kept = velum.remask(store["texts"], store["spans"], cfg)
    assert exchanges(plain) > 0 and exchanges(kept) == 0
    assert rows(kept) == rows(plain)
    assert any("<TEL>" in r.masked_text or "<" in r.masked_text for r in kept.collect() if r.masked_text)


@pytest.mark.parametrize("merge", [False, True])
def test_deidentify_without_exchange(tables, store, merge):
    docs, _, raw = tables
    plain = velum.deidentify(docs, CFG, merge, model_spans=raw, span_models=("stanza",))
    kept = velum.deidentify(store["texts"], CFG, merge, model_spans=store["reports"], span_models=("stanza",))
    assert exchanges(plain) > 0 and exchanges(kept) == 0
    assert rows(kept) == rows(plain)


def test_layout(spark, tables, tmp_path):
    docs, _, raw = tables
    write_store(f"{tmp_path}/own", docs)
    assert read_store(spark, f"{tmp_path}/own")["texts"].rdd.getNumPartitions() == 1
    with pytest.raises(ValueError, match="different types"):
        write_store(f"{tmp_path}/other", docs, 3, spans=raw.withColumn("doc_id", F.lit(1)))
    with pytest.raises(Exception):
        write_store(f"{tmp_path}/own", docs)
