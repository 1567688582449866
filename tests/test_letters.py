"""The letters of the catalogue are built by compiled code."""

import datetime as dt

from catalog import inputs


def test_letters_without_lambdas(spark, tmp_path):
    day = dt.date(1995, 3, 9)
    orders = [(k, k % 3, day if k % 4 else None) for k in range(40)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    customers = [(0, "Customer#0"), (1, "Così"), (2, None)]
    spark.createDataFrame(customers, "c_custkey long, c_name string").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    letters, gold = inputs.letters(spark, str(tmp_path)), inputs.letters_gold(spark, str(tmp_path))
    for df in (letters, gold):
        assert "lambda" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "filter(array(" not in gold._jdf.queryExecution().optimizedPlan().toString()
    texts = {r.doc_id: r.text for r in letters.collect()}
    assert len(texts) == 40 and texts["l1"].startswith("Gentile Così, visita del 9-3-1995 in Via Emilia 1")
    # What is missing is left out of a text, and spans behind it have no place.
    assert texts["l2"].startswith("Gentile , visita del 9 marzo 1995")
    spans = [r for r in gold.collect() if r.doc_id == "l1"]
    shown = {r.entity_type: texts["l1"][r.start : r.end] for r in spans if r.start < 60}
    assert shown == {"NAME": "Così", "DATE": "9-3-1995", "LOC": "Via Emilia 1"}
    assert sorted(r.entity_type for r in gold.collect() if r.doc_id == "l11") == sorted(
        ["NAME", "DATE", "LOC", "AGE", "TEL", "CF", "ZIP", "DATE"]
    )
    assert all(r.start is None for r in gold.filter("doc_id = 'l2' AND entity_type = 'LOC'").collect())


def test_letters_are_the_values_of_their_pieces(spark, tmp_path):
    """The text is made without the array of pieces."""
    orders = [(k, k % 3, dt.date(1995, 1 + k % 12, 9) if k % 4 else None) for k in range(300)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderdate date").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.createDataFrame([(0, "Così"), (1, None)], "c_custkey long, c_name string").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    made = inputs.letters(spark, str(tmp_path))
    joined = inputs._pieces(spark, str(tmp_path)).selectExpr(
        "doc_id", "array_join(pieces.value, '') AS text"
    )
    assert sorted(made.collect()) == sorted(joined.collect())
    assert "array(" not in made._jdf.queryExecution().optimizedPlan().toString()
