"""Model spans: intake, running annotators, and configuration."""

import json

import pytest
from pyspark.sql import functions as F

import velum
from velum.operators.models import batched, intake_spans, loaded_model

MIXED = {"models": {"person": "stanza", "address": "spacy", "zipcode": "john", "date": "regex"}}
MODELS = ("john", "stanza", "spacy")
RAW = [
    ("a", 0, 4, "PER", "Aldo", "stanza"),
    ("a", 0, 4, "PER", "Aldo", "spacy"),
    ("a", 7, 12, "LOC", "Imola", "spacy"),
    ("a", 13, 17, "ZIP", "40026", "john"),
    ("a", 0, 4, "MISC", "Aldo", "stanza"),
    ("a", 0, 4, "DATE", "Aldo", "john"),
]


def docs(spark):
    return spark.createDataFrame([("a", "Aldo a Imola 40026 il 3/4/2020")], "doc_id string, text string")


def raw(spark):
    return spark.createDataFrame(
        RAW, "doc_id string, start int, end int, label string, text string, model string"
    )


def test_intake(spark):
    taken = intake_spans(raw(spark), velum.DeidConfig.from_dict(MIXED), inclusive_end=("john",))
    rows = {(r.start, r.end, r.entity_type, r.model, r["rank"]) for r in taken.collect()}
    assert rows == {
        (0, 4, "PERSONA", "stanza", 8),
        (7, 12, "INDIRIZZO", "spacy", 7),
        (13, 18, "CAP", "john", 6),
    }


def test_deidentify_with_table(spark):
    cfg = velum.DeidConfig.from_dict(MIXED)
    spans = raw(spark).withColumn("end", F.col("end") + (F.col("model") == "john").cast("int"))
    out = velum.deidentify(docs(spark), cfg, merge=True, model_spans=spans, span_models=MODELS).first()
    assert out.masked_text == "<PERSONA> a <INDIRIZZO> <CAP> il <DATA>"
    twice = velum.deidentify(docs(spark), cfg, model_spans=spans.unionAll(spans), span_models=MODELS).first()
    assert twice.masked_text == out.masked_text
    assert [s.entity_type for s in twice.spans].count("PERSONA") == 1 and len(twice.spans) == 4
    assert velum.find_spans(docs(spark), cfg, model_spans=spans, span_models=MODELS).count() == 4
    assert velum.find_spans(docs(spark), cfg, merge=True, model_spans=spans, span_models=MODELS).count() == 4


def test_annotators_run_in_place(spark):
    def people():
        return lambda text: [(0, 4, "PER", text[:4])] if text.startswith("Aldo") else []

    cfg = velum.DeidConfig.from_dict(MIXED)
    df = docs(spark).unionAll(spark.createDataFrame([("b", None)], "doc_id string, text string"))
    with pytest.raises(ValueError, match="john, spacy"):
        velum.deidentify(df, cfg, annotators={"stanza": people})
    with pytest.raises(ValueError, match="stanza"):
        velum.find_spans(df, cfg, skip_models=("john", "spacy"))
    out = velum.deidentify(
        df, cfg, annotators={"stanza": people, "unused": None}, skip_models=("john", "spacy")
    )
    rows = {r.doc_id: r for r in out.collect()}
    assert rows["a"].masked_text == "<PERSONA> a Imola 40026 il <DATA>"
    assert rows["b"].masked_text is None


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"name": "x", "mask": {"special_character": "#@"}, **MIXED}))
    cfg = velum.DeidConfig.from_json(str(path))
    assert (cfg.mode, cfg.special_character, cfg.date_level, cfg.name) == ("tag", "#", "hide", "x")
    assert cfg.pattern_entities == ["date"]
    assert cfg.model_entities == {"john": ["zipcode"], "spacy": ["address"], "stanza": ["person"]}
    later = velum.DeidConfig.from_dict({"models": {"date": ""}, "mask": {"mode": "anon"}}, cfg)
    assert (later.models["date"], later.models["person"], later.mode) == ("", "stanza", "anon")
    for bad in (
        {"mask": {"mode": "random"}},
        {"mask": {"date_level": "day"}},
        {"mask": {"special_character": ""}},
        {"models": {"date": "other"}},
        {"models": {"person": "regex"}},
        {"models": {"date": "spacy"}},
        {"models": {"telephone": "stanza"}},
    ):
        with pytest.raises(ValueError):
            velum.DeidConfig.from_dict(bad)


def test_a_worker_loads_a_model_once(spark, tmp_path):
    """Eight tasks, and no worker with a second load."""
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        open(f"{folder}/{os.getpid()}-{uuid.uuid4().hex}", "w").close()
        return lambda text: [(0, 1, "PER", text[:1])]

    cfg = velum.DeidConfig.from_dict({"models": {"person": "stanza"}})
    df = spark.range(400, numPartitions=40).selectExpr("cast(id AS string) AS doc_id", "'Aldo' AS text")
    found = velum.find_spans(df, cfg, annotators={"stanza": factory})
    assert found.count() == 400
    loads = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(loads) == len(set(loads)) < 40


def test_a_table_of_spans_names_its_models(spark):
    """Spans of one model do not stand for those of another one."""
    cfg = velum.DeidConfig.from_dict({"models": {"person": "stanza", "address": "spacy"}})
    spans = raw(spark).filter("model = 'spacy'")
    with pytest.raises(ValueError, match="stanza"):
        velum.deidentify(docs(spark), cfg, model_spans=spans, span_models=("spacy",))
    with pytest.raises(ValueError, match="spacy, stanza"):
        velum.find_spans(docs(spark), cfg, model_spans=spans)
    with pytest.raises(ValueError, match="no table"):
        velum.find_spans(docs(spark), cfg, span_models=("spacy", "stanza"))
    with pytest.raises(ValueError, match="list"):
        velum.find_spans(docs(spark), cfg, model_spans=spans, span_models="spacy")
    found = velum.find_spans(docs(spark), cfg, model_spans=spans, span_models=("spacy",), skip_models=("stanza",))
    assert {r.model for r in found.collect()} == {"spacy"}


def test_batches_of_different_texts(spark, tmp_path):
    """Several plans: each worker loads the model once, and no batch has a text twice."""
    folder = str(tmp_path)

    def factory():
        import os
        import uuid

        def note(what):
            open(f"{folder}/{what}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def find(texts):
            assert len(set(texts)) == len(texts) <= 5
            note(f"call{len(texts)}")
            return [[(0, 4, "PER", t[:4])] if t.startswith("Aldo") else [] for t in texts]

        note("load")
        return find

    cfg = velum.DeidConfig.from_dict({"models": {"person": "stanza"}})
    text = "CASE WHEN id % 10 = 9 THEN NULL ELSE concat(if(id % 2 = 0, 'Aldo ', 'Bice '), id % 10) END AS text"
    df = spark.range(400, numPartitions=4).selectExpr("cast(id AS string) AS doc_id", text)
    for _ in range(3):
        found = velum.find_spans(df, cfg, annotators={"stanza": batched(factory, 5)})
        assert found.count() == 200
    notes = [p.name.split("-") for p in tmp_path.iterdir()]
    loads = [pid for what, pid, _ in notes if what == "load"]
    assert len(loads) == len(set(loads))
    # Nine different texts a task, in lists of five and four.
    assert sorted(what for what, *_ in notes if what != "load") == ["call4"] * 12 + ["call5"] * 12
    with pytest.raises(ValueError):
        batched(factory, 0)


def test_few_models_stay_loaded():
    loads = []
    for k in [*range(10), 9, 2, 0]:
        loaded_model("m", str(k), lambda k=k: loads.append(k) or k)
    assert loads == [*range(10), 0]
