"""Inputs of the catalogue's queries, derived from the given tables.

Letters are built from orders and their customers: a text made of pieces, of which
some are labelled, so that gold spans follow from the piece lengths. Token/BIO texts
are built from documents. An expression used here is plain SQL that the oracle can
take over word for word; what the operators do with it is written twice."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import velum
from velum.labels import CORPUS_MARKER, MONTHS

REFERENCE_DATE = dt.date(2026, 12, 1)

REGEX_CONFIG = {
    "name": "regex",
    "models": {
        "telephone": "regex",
        "zipcode": "regex",
        "email": "regex",
        "fiscal_code": "regex",
        "date": "regex",
        "age": "regex",
    },
}
DATES_CONFIG = {"name": "dates", "models": {"date": "regex", "age": "regex"}}
# The letter that is scored alone.
ONE_LETTER = "l7"

# The models whose spans the table of model spans has.
REPORTING = ("john", "stanza", "spacy")
MIXED_CONFIG = {
    "name": "mixed",
    "models": {
        "telephone": "regex",
        "date": "regex",
        "age": "regex",
        "zipcode": "john",
        "email": "john",
        "person": "stanza",
        "address": "spacy",
    },
}


def config(values: dict, **mask) -> velum.DeidConfig:
    return velum.DeidConfig.from_dict({**values, "mask": mask}, reference_date=REFERENCE_DATE)


def _text(number: str, width: int = 0) -> str:
    cast = f"CAST({number} AS STRING)"
    return f"lpad({cast}, {width}, '0')" if width else cast


_DAY, _MONTH, _YEAR = "day(o_orderdate)", "month(o_orderdate)", _text("year(o_orderdate)")
_MONTH_NAME = (
    f"CASE {_MONTH} "
    + " ".join(f"WHEN {int(n)} THEN '{name}'" for name, n in MONTHS if len(name) > 3)
    + " END"
)
_DATE = f"""CASE o_orderkey % 7
    WHEN 0 THEN {_text(_DAY, 2)} || '/' || {_text(_MONTH, 2)} || '/' || {_YEAR}
    WHEN 1 THEN {_text(_DAY)} || '-' || {_text(_MONTH)} || '-' || {_YEAR}
    WHEN 2 THEN {_text(_DAY)} || ' ' || {_MONTH_NAME} || ' ' || {_YEAR}
    WHEN 3 THEN upper({_MONTH_NAME}) || ' ' || {_YEAR}
    WHEN 4 THEN {_text(_DAY)} || '.' || {_text(_MONTH, 2)} || '.' || {_YEAR}
    WHEN 5 THEN {_text(_MONTH, 2)} || '/' || substring({_YEAR}, 3, 2)
    ELSE {_YEAR} END"""
_AGE = _text("o_orderkey % 90 + 5")
_PHONE = f"""CASE WHEN o_orderkey % 5 = 4 THEN '+39 ' ELSE '' END || '3' || {_text("o_orderkey % 100", 2)}
    || CASE o_orderkey % 3 WHEN 0 THEN ' ' WHEN 1 THEN '/' ELSE '' END
    || {_text("o_orderkey * 37 % 10000000", 7)}"""
_FISCAL = f"""substring('ABCDEFGHIJKLMNOP', CAST(1 + o_orderkey % 10 AS INT), 6) || {_text("o_orderkey % 100", 2)}
    || 'E' || {_text("o_orderkey % 31", 2)} || 'H' || {_text("o_orderkey % 1000", 3)} || 'W'"""

# Gold label, text, and how many characters at the end the gold span leaves out.
LETTER_PIECES = (
    ("''", "'Gentile '", "0"),
    ("'NAME'", "c_name", "0"),
    ("''", "', visita del '", "0"),
    (
        "CASE WHEN o_orderkey % 7 = 6 THEN 'YEAR' ELSE 'DATE' END",
        _DATE,
        "CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END",
    ),
    ("''", "' in '", "0"),
    ("'LOC'", "'Via Emilia ' || CAST(o_orderkey % 80 AS STRING)", "0"),
    ("''", "': paziente di '", "0"),
    (
        "'AGE'",
        f"CASE WHEN o_orderkey % 2 = 0 THEN 'anni ' || {_AGE} ELSE {_AGE} || ' anni' END",
        "CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 5 END",
    ),
    ("''", "', tel. '", "0"),
    ("'TEL'", _PHONE, "0"),
    ("''", "', posta '", "0"),
    (
        "CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE 'EMAIL' END",
        f"'utente' || {_text('o_orderkey')} || '@posta' || {_text('o_orderkey % 13')} || '.example.it'",
        "0",
    ),
    ("''", "', codice '", "0"),
    ("'CF'", _FISCAL, "0"),
    ("''", "', CAP '", "0"),
    ("'ZIP'", _text("o_orderkey * 7 % 100000", 5), "0"),
    ("''", "'. Pratica ' || CAST(o_orderkey AS STRING) || '; controllo il '", "0"),
    ("'DATE'", f"{_text('o_orderkey % 31 + 1')} || '/' || {_text('o_orderkey % 12 + 1')}", "0"),
    ("''", "'.'", "0"),
)

# Token label of word number i (from 0) with text w.
TOKEN_LABEL = """CASE i % 17
    WHEN 1 THEN 'I-HOSPITAL' WHEN 3 THEN 'B-DOCTOR' WHEN 4 THEN 'I-DOCTOR'
    WHEN 5 THEN CASE WHEN length(w) % 2 = 0 THEN 'I-DOCTOR' ELSE 'O' END
    WHEN 8 THEN 'B-CITY' WHEN 9 THEN 'I-CITY' WHEN 11 THEN 'B-DATE' WHEN 12 THEN 'I-DATE'
    WHEN 13 THEN 'B-ORGANIZATION' WHEN 14 THEN 'B-ORGANIZATION' WHEN 15 THEN 'I-ORGANIZATION'
    WHEN 16 THEN CASE WHEN i % 2 = 0 THEN 'B-AGE' ELSE 'B-HOSPITAL' END
    ELSE 'O' END"""
# The same, looked up where the word has no say, instead of compared with one after the other.
_FIXED = (
    "O I-HOSPITAL O B-DOCTOR I-DOCTOR O O O B-CITY I-CITY O B-DATE I-DATE "
    "B-ORGANIZATION B-ORGANIZATION I-ORGANIZATION O"
).split()
_LOOKED_UP = f"""CASE WHEN i % 17 = 5 THEN CASE WHEN length(w) % 2 = 0 THEN 'I-DOCTOR' ELSE 'O' END
    WHEN i % 17 = 16 THEN CASE WHEN i % 2 = 0 THEN 'B-AGE' ELSE 'B-HOSPITAL' END
    ELSE get(array({', '.join(f"'{x}'" for x in _FIXED)}), i % 17) END"""
SENTENCE_WORDS = 40
CHUNK_WORDS = 60


# Session setting: deal the rows of each table read to so many partitions. For tables of
# one row group on one machine (bench.py sets it); a table of many splits needs none.
PARTITIONS = "velum.input.partitions"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    n = df.sparkSession.conf.get(PARTITIONS, "")
    return df.repartition(int(n)) if n else df


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customers."""
    orders = dealt(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    structs = ", ".join(
        f"named_struct('label', {label}, 'value', {value}, 'cut', {cut})"
        for label, value, cut in LETTER_PIECES
    )
    return _orders(spark, sf_dir).select(
        F.concat(F.lit("l"), "o_orderkey").alias("doc_id"),
        F.col("o_orderkey"),
        F.expr(f"array({structs})").alias("pieces"),
    )


def _values(piece) -> list:
    """What ``piece`` makes of each of the pieces, named one by one: unlike a lambda over
    them that is compiled."""
    return [piece(f"pieces[{i}]") for i in range(len(LETTER_PIECES))]


def letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text``: one letter per order. Only the values are made, not the array of
    pieces, which takes longer than the text."""
    values = ", ".join(value for _, value, _ in LETTER_PIECES)
    return _orders(spark, sf_dir).selectExpr(
        "concat('l', o_orderkey) AS doc_id", f"concat_ws('', {values}) AS text"
    )


def _labelled(pieces: DataFrame) -> DataFrame:
    # The pieces are so many in each letter: their ends are plain columns, and the array made
    # of them has no null, so that nothing is to be taken out of it ahead of the rows.
    n = len(LETTER_PIECES)
    lengths = _values(lambda p: f"length({p}.value)")
    ends = [f"{' + '.join(lengths[: i + 1])} AS end_{i}" for i in range(n)]
    placed = ", ".join(
        f"named_struct('start', {f'end_{i - 1}' if i else '0'}, 'end', end_{i}, "
        f"'entity_type', pieces[{i}].label, 'cut', pieces[{i}].cut, 'text', pieces[{i}].value)"
        for i in range(n)
        if LETTER_PIECES[i][0] != "''"
    )
    return (
        pieces.selectExpr("doc_id", "o_orderkey", "pieces", *ends)
        .selectExpr("doc_id", "o_orderkey", f"inline(array({placed}))")
        .filter("entity_type <> ''")
    )


def letters_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans of the letters; some dates and ages are cut short."""
    return _labelled(_pieces(spark, sf_dir)).select(
        "doc_id", "start", (F.col("end") - F.col("cut")).alias("end"), "entity_type"
    )


def letters_tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters with each labelled piece as its inline tag and filler."""

    def tagged(p):
        tag = F.concat(F.lit("<"), p["label"], F.lit(">"))
        fill = F.greatest(F.length(p["value"]) - F.length(tag), F.lit(0))
        return F.when(p["label"] == "", p["value"]).otherwise(F.concat(tag, F.repeat(F.lit("#"), fill)))

    return _pieces(spark, sf_dir).select(
        "doc_id", F.array_join(F.transform("pieces", tagged), "").alias("text")
    )


# Gold label -> (model, raw label) pairs under which models report such a piece.
MODEL_REPORTS = (
    ("NAME", "stanza", "PER"),
    ("NAME", "spacy", "PER"),
    ("LOC", "spacy", "LOC"),
    ("LOC", "john", "CITY"),
    ("ZIP", "john", "ZIP"),
    ("EMAIL", "john", "E-MAIL"),
    ("DATE", "john", "DATE"),
)


def model_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model spans on the letters; the third model reports last positions, and
    each tenth letter's spans come twice."""
    reports = F.array(
        *[
            F.struct(F.lit(g).alias("gold"), F.lit(m).alias("model"), F.lit(x).alias("label"))
            for g, m, x in MODEL_REPORTS
        ]
    )
    copies = F.expr("sequence(1, CASE WHEN o_orderkey % 10 = 0 THEN 2 ELSE 1 END)")
    last = F.when(F.col("report.model") == "john", 1).otherwise(0)
    return (
        _labelled(_pieces(spark, sf_dir))
        .withColumn("report", F.explode(F.filter(reports, lambda r: r["gold"] == F.col("entity_type"))))
        .withColumn("copy", F.explode(copies))
        .select(
            "doc_id",
            "start",
            (F.col("end") - last).alias("end"),
            F.col("report.label").alias("label"),
            "text",
            F.col("report.model").alias("model"),
        )
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(
        table(spark, sf_dir, "documents").select(
            F.concat(F.lit("d"), "doc_id").alias("doc_id"), "text"
        )
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts: documents, conversation turns, benchmark items and letters."""
    turns = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.lit("c"), "conv_id", "turn").alias("doc_id"), "text"
    )
    items = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("b"), "item_id").alias("doc_id"), "text"
    )
    return (
        documents(spark, sf_dir)
        .unionAll(dealt(turns))
        .unionAll(items)
        .unionAll(letters(spark, sf_dir))
    )


def partial_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold spans for every third letter; those of every thirtieth belong to no text."""
    number = F.expr("cast(substring(doc_id, 2) AS long)")
    ghost = F.when(number % 30 == 0, F.concat(F.lit("g"), "doc_id")).otherwise(F.col("doc_id"))
    return letters_gold(spark, sf_dir).filter(number % 3 == 0).withColumn("doc_id", ghost)


def _token_lines(spark: SparkSession, sf_dir: str, line: str) -> DataFrame:
    words = F.expr(r"filter(split(regexp_replace(text, '[ \n\r\t]+', ' '), ' '), w -> w <> '')")
    return (
        documents(spark, sf_dir)
        .select("doc_id", words.alias("words"))
        .select("doc_id", F.expr(f"array_join(transform(words, (w, i) -> {line}), '\\n')").alias("lines"))
    )


def token_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token/BIO texts: a dummy sentence, then sentences of equal
    length, each closed by a blank line, then an unclosed dummy sentence."""
    line = (
        f"concat(w, ' ', {_LOOKED_UP}, "
        f"CASE WHEN i % {SENTENCE_WORDS} = {SENTENCE_WORDS - 1} THEN '\\n' ELSE '' END)"
    )
    return _token_lines(spark, sf_dir, line).select(
        "doc_id", F.concat(F.lit("TEST_NLP test\n\n"), "lines", F.lit("\n\nTEST_NLP test")).alias("text")
    )


def raw_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as raw token/BIO corpora with a marker between chunks and a blank
    line after every third line."""
    marker = CORPUS_MARKER.replace("\n", "\\n")
    line = (
        f"concat(CASE WHEN i % {CHUNK_WORDS} = 0 AND i > 0 THEN '{marker}' ELSE '' END, "
        f"w, ' ', {_LOOKED_UP}, CASE WHEN i % 3 = 2 THEN '\\n' ELSE '' END)"
    )
    return _token_lines(spark, sf_dir, line).select(
        F.col("doc_id").alias("corpus_id"), F.concat("lines", F.lit("\n")).alias("text")
    )
