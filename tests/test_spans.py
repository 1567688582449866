"""Resolution, masking and de-identification."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

import velum
from velum.functions.finders import SPAN
from velum.functions.mask import mask
from velum.functions.resolve import resolve
from velum.operators.spans import resolve_spans, span_text

REFERENCE = dt.date(2026, 12, 1)
REGEX = {
    "models": dict.fromkeys(["telephone", "zipcode", "email", "fiscal_code", "date", "age"], "regex")
}
TEXT = (
    "Paziente di anni 66, visita del 28/06/2022. Tel 349 1234567, a.b@example.it, "
    "CF QWXZKJ61P07M554T, CAP 47122."
)
MASKED = {
    "tag": "Paziente di <ETÀ>, visita del <DATA>. Tel <TELEFONO>, <E-MAIL>, CF <CF>, CAP <CAP>.",
    "tag_l": "Paziente di <ETÀ>**, visita del <DATA>****. Tel <TELEFONO>*, <E-MAIL>******, "
    "CF <CF>************, CAP <CAP>.",
    "anon": "Paziente di ***, visita del ***. Tel ***, ***, CF ***, CAP ***.",
    "anon_l": "Paziente di *******, visita del **********. Tel ***********, **************, "
    "CF ****************, CAP *****.",
}


def config(values=REGEX, **mask_values):
    return velum.DeidConfig.from_dict({**values, "mask": mask_values}, reference_date=REFERENCE)


def greedy(spans, touching="drop"):
    kept = []
    for s in sorted(spans):
        last = max((k[1] for k in kept), default=None)
        touches = touching == "keep" and s[0] == last and s[1] > s[0]
        if last is None or s[0] > last or touches:
            kept.append(s)
    return kept


def span(start, end, rank=0, seq=0):
    return (start, end, rank, seq, "X", "", "regex")


def both_ways(spark, per_doc, touching="drop"):
    in_row = spark.createDataFrame(list(per_doc.items()), f"doc_id int, spans array<{SPAN}>")
    one = {
        r.doc_id: [tuple(s) for s in r.kept]
        for r in in_row.selectExpr("doc_id", f"{resolve('spans', touching)} AS kept").collect()
    }
    flat = in_row.selectExpr("doc_id", "inline(spans)")
    two = {d: [] for d in per_doc}
    for r in resolve_spans(flat, touching).collect():
        two[r[0]].append(tuple(r)[1:])
    return one, {d: sorted(s) for d, s in two.items()}


def test_listed_overlaps(spark):
    spans = [span(0, 5), span(3, 10), span(6, 8), span(8, 9), span(10, 12)]
    one, two = both_ways(spark, {0: spans})
    assert [s[:2] for s in one[0]] == [(0, 5), (6, 8), (10, 12)]
    assert one == two


@pytest.mark.parametrize("touching", ["drop", "keep"])
def test_random_overlaps(spark, touching):
    rng = random.Random(touching)
    per_doc = {}
    for d in range(150):
        width = rng.choice([20, 200, 4000])
        per_doc[d] = [
            span(s, s + rng.randint(0, 9), rng.randint(0, 8), i)
            for i in range(rng.randint(0, 400))
            for s in [rng.randint(0, width)]
        ]
    # One span over a whole document, and one document with very many copies.
    per_doc[150] = [span(0, 10_000)] + [span(i, i + 2, 0, i) for i in range(0, 12_000, 3)]
    per_doc[151] = [span(i % 50, i % 50 + 3, i % 9, i) for i in range(20_000)]
    want = {d: greedy(s, touching) for d, s in per_doc.items()}
    one, two = both_ways(spark, per_doc, touching)
    assert one == want
    assert two == want


@pytest.mark.parametrize("touching", ["drop", "keep"])
def test_overlaps_over_tiles(spark, touching, monkeypatch):
    """Chains over many tiles, spans that end at, before and behind a border or cover
    whole tiles, tiles without spans, a document without an identifier."""
    monkeypatch.setattr(velum.operators.spans, "TILE_BITS", 3)
    rng = random.Random(touching)
    per_doc = {}
    for d in range(120):
        width, longest = rng.choice([30, 300, 2000]), rng.choice([2, 9, 17, 200])
        starts = [rng.randint(0, width) for _ in range(rng.randint(1, 250))]
        per_doc[d] = [span(s, s + rng.randint(0, longest), 0, i) for i, s in enumerate(starts)]
    per_doc[120] = [span(i, i + 1) for i in range(900)]
    per_doc[121] = [span(i, i + 40 + i % 7) for i in range(700)]
    per_doc[None] = [span(8 * i, 8 * i + 8) for i in range(50)]
    flat = [(d, *s) for d, found in per_doc.items() for s in found]
    table = spark.createDataFrame(flat, "doc_id int, " + SPAN[7:-1].replace(":", " "))
    got = {d: [] for d in per_doc}
    for r in resolve_spans(table, touching).collect():
        got[r[0]].append(tuple(r)[1:])
    assert {d: sorted(s) for d, s in got.items()} == {d: greedy(s, touching) for d, s in per_doc.items()}


def test_one_document_over_many_tasks(spark):
    """No task orders a whole document: its spans are dealt by tile, once for both uses."""
    table = spark.range(200_000).selectExpr(
        "'a' AS doc_id", "cast(id * 7 AS int) AS start", "cast(id * 7 + 1 + id % 23 AS int) AS end",
        "0 AS rank", "0 AS seq", "'X' AS entity_type", "'' AS text", "'regex' AS model",
    )
    out = resolve_spans(table)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = resolve_spans(table)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert "Window" not in plan
    assert plan.count("ReusedExchange") == 1
    tasks = out.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(tasks) > 1
    want = greedy([(i * 7, i * 7 + 1 + i % 23) for i in range(200_000)][:30_000])
    first = out.filter("start < 200000").select("start", "end").orderBy("start").collect()
    assert [tuple(r) for r in first] == [s for s in want if s[0] < 200_000]


def test_spans_are_moved_once(spark):
    """Only the exchange by tile has texts of spans; what else is moved is places."""
    table = spark.createDataFrame(
        [("a", *span(0, 3)), ("a", *span(0, 3)), ("b", *span(5, 9)), (None, *span(1, 2))],
        "doc_id string, " + SPAN[7:-1].replace(":", " "),
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = resolve_spans(table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        rows = out.select("doc_id", "start", "end").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "Reused" not in line]
    assert len(moved) == 3
    assert sorted(map(str, map(tuple, rows))) == sorted(map(str, [("a", 0, 3), ("b", 5, 9), (None, 1, 2)]))


def test_equal_spans_combine_ahead_of_the_shuffle(spark):
    """A start that has no end hides the others at its start, as it did."""
    table = spark.range(40_000).selectExpr(
        "'a' AS doc_id", "0 AS start", "CASE WHEN id = 7 THEN NULL ELSE cast(3 + id % 5 AS int) END AS end",
        "0 AS rank", "0 AS seq", "'X' AS entity_type", "'' AS text", "'regex' AS model",
    )
    assert resolve_spans(table).count() == 0
    assert [tuple(r)[1:3] for r in resolve_spans(table.filter("end IS NOT NULL")).collect()] == [(0, 3)]


@pytest.mark.parametrize("mode", MASKED)
def test_masks(spark, mode):
    df = spark.createDataFrame([("a", TEXT), ("b", "niente"), ("c", "")], "doc_id string, text string")
    out = {r.doc_id: r for r in velum.deidentify(df, config(mode=mode), merge=True).collect()}
    assert out["a"].masked_text == MASKED[mode]
    assert [(s.start, s.end) for s in out["a"].spans] == [
        (12, 19), (32, 42), (48, 59), (61, 75), (80, 96), (102, 107)
    ]
    assert (out["b"].masked_text, out["c"].masked_text) == ("niente", "")
    again = velum.remask(df, velum.find_spans(df, config()), config(mode=mode)).collect()
    assert {r.doc_id: r.masked_text for r in again} == {d: r.masked_text for d, r in out.items()}


@pytest.mark.parametrize("mode", MASKED)
@pytest.mark.parametrize("level, shown", [("year", "2022"), ("month", "6-2022")])
def test_date_levels(spark, mode, level, shown):
    df = spark.createDataFrame([("a", TEXT)], "doc_id string, text string")
    text = velum.deidentify(df, config(mode=mode, date_level=level)).first().masked_text
    assert f"visita del {shown}. Tel" in text


def test_date_level_reads_italian_months(spark):
    df = spark.createDataFrame([("a", "dal 7 Gennaio 2020 in poi")], "doc_id string, text string")
    text = velum.deidentify(df, config(mode="tag", date_level="month")).first().masked_text
    assert text == "dal 1-2020 in poi"


def test_mask_cuts_long_texts(spark):
    rng = random.Random(7)
    text = "".join(rng.choices("aè𝄞 ", k=9000))
    kept = [span(s, s + rng.choice([1, 5, 1500])) for s in range(0, 9000 - 1500, 700)]
    kept = greedy(kept)
    df = spark.createDataFrame([(text, kept)], f"text string, kept array<{SPAN}>")
    want, at = "", 0
    for s in kept:
        want, at = want + text[at : s[0]] + "*" * (s[1] - s[0]), s[1]
    assert df.select(F.expr(mask("text", "kept", "anon_l"))).first()[0] == want + text[at:]


def test_all_or_kept_spans(spark):
    df = spark.createDataFrame([("a", "12/3 34812345678 x")], "doc_id string, text string")
    every = velum.find_spans(df, config()).collect()
    kept = velum.find_spans(df, config(), merge=True).collect()
    assert len(every) > len(kept)
    assert set(kept) <= set(every)


def test_span_text(spark):
    docs = spark.createDataFrame([("a", "è il 𝄞 caso")], "doc_id string, text string")
    spans = spark.createDataFrame([("a", 5, 6)], "doc_id string, start int, end int")
    assert span_text(spans, docs).first().text == "𝄞"


def test_no_shuffle_and_one_evaluation(spark):
    """Detection and masking are a projection, and no filter repeats the finders."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for out in (velum.deidentify(df, config()), velum.find_spans(df, config(), merge=True)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan
        assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
        assert "Filter (" not in plan and "+- Filter" not in plan


def test_runs_on_a_stream(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", TEXT)], "doc_id string, text string").write.parquet(str(source))
    stream = spark.readStream.schema("doc_id string, text string").parquet(str(source))
    out = velum.deidentify(stream, config(mode="tag"))
    query = (
        out.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    assert query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first().masked_text == MASKED["tag"]
