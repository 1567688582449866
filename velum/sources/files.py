"""Readers and writers.

Offsets are exclusive inside the engine. Annotation files use other conventions,
which are converted here and nowhere else: letter files give the last covered
position, token-corpus files count the blank after the span."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from velum.functions.arrays import rows
from velum.labels import CORPUS_MARKER
from velum.operators.annotations import MIN_CHUNK, SEPARATORS, chunks, wrapped

LETTER_GOLD = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("entity_type", T.StringType()),
    ]
)
CASE_GOLD = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("bio_label", T.StringType()),
        T.StructField("entity_type", T.StringType()),
    ]
)
SCORES = T.StructType(
    [
        T.StructField("entity", T.StringType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("score_type", T.StringType()),
    ]
)
INDEXED_SCORES = T.StructType([T.StructField("index", T.LongType()), *SCORES.fields])
RECORDS = "array<struct<text:string,labels:array<array<string>>>>"
#: Splits whose numbers are kept in every task of ``read_raw_corpora`` (some 50 bytes each).
MOST_SPLITS = 2_000_000
RECORD_FORMATS = ("json", "jsonl")
# Texts that JSON writes as they are, between quotes.
PLAIN = r"\A[ !#-\[\]-~]*\z"


def _decoded(name: Column) -> Column:
    """Spark gives paths with special characters escaped, blanks as ``%20``."""
    return F.url_decode(F.replace(name, F.lit("+"), F.lit("%2B")))


def _file_name() -> Column:
    return _decoded(F.col("_metadata.file_name"))


def _plain_glob(name: str) -> str:
    """A name as a pattern that only that name fits."""
    return "".join(f"\\{c}" if c in "\\*?[]{}^," else c for c in name)


def _whole_files(spark: SparkSession, path: str, glob: str, keep: Column, doc_id: Column):
    """One row per file; line ends of any kind become ``\\n``."""
    return (
        spark.read.option("pathGlobFilter", glob)
        .text(path, wholetext=True)
        .filter(keep)
        .select(doc_id.alias("doc_id"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))
    )


def read_documents(spark: SparkSession, path: str, doc_id: str | None = None) -> DataFrame:
    """Every ``*.txt`` file without ``_`` in its name as one document. With ``doc_id`` only
    that document's file is read; the others are left out by name before any is opened."""
    return _whole_files(
        spark,
        path,
        "*.txt" if doc_id is None else f"{_plain_glob(doc_id)}.txt",
        ~_file_name().contains("_"),
        F.regexp_extract(_file_name(), r"^(.*)\.txt", 1),
    )


def read_inline_tagged(spark: SparkSession, path: str) -> DataFrame:
    """Every ``<doc_id>_anon.txt`` file as one inline-tagged document."""
    return _whole_files(
        spark, path, "*_anon.txt", F.lit(True), F.regexp_extract(_file_name(), r"^(.*)_anon\.txt", 1)
    )


def read_token_texts(spark: SparkSession, path: str, sep: str = " ") -> DataFrame:
    """Every ``*.txt`` file as one token/BIO document."""
    if sep not in SEPARATORS:
        raise ValueError(f"token separator must be one of {SEPARATORS}, not {sep!r}")
    return _whole_files(
        spark, path, "*.txt", F.lit(True), F.regexp_extract(_file_name(), r"^(.*)\.txt", 1)
    )


def read_raw_corpora(
    spark: SparkSession,
    path: str,
    glob: str = "*",
    marker: str = CORPUS_MARKER,
    min_length: int = MIN_CHUNK,
    newline: str = "\n",
) -> DataFrame:
    """Raw corpus files cut into documents at ``marker``: ``corpus_id`` (the file's name
    without its ending), ``doc_index`` within the file, ``text``; the rows of
    ``split_corpus`` over whole files, but a file is read by as many tasks as it has splits.

    The marker delimits records, so a split begins and ends with one, and no task holds more
    than a record. One pass counts the documents of each split; from these come the numbers
    of the first documents of the splits, and the second pass counts on from there. Texts are
    not moved. ``newline`` is the line end of the files; in files with another one, which
    give the same rows, no marker is found before the lines are read, so they are not split.
    """
    if marker.startswith("\n") or "\n\n" in marker or any(
        marker.endswith(marker[:k]) for k in range(1, len(marker))
    ):
        raise ValueError("a marker must not begin with a line end, hold a blank line, or end as it begins")
    value = F.regexp_replace("value", "\r\n?", "\n").alias("value")
    file, block = F.col("_metadata.file_path"), F.col("_metadata.file_block_start")
    records = (
        spark.read.option("lineSep", marker.replace("\n", newline))
        .option("pathGlobFilter", glob)
        .text(path)
        .select(file.alias("file"), block.alias("block"), value)
        .withColumn("place", F.monotonically_increasing_id())
    )
    first, other = (chunks("value", marker, min_length, behind) for behind in (False, True))
    # The very first record of a file is the only one that is not behind a marker.
    counted = records.selectExpr("file", "block", "place", f"size({first}) AS n_first", f"size({other}) AS n")
    at_first = F.min(F.struct("place", "n_first", "n"))
    blocks = counted.groupBy("file", "block").agg(F.sum("n").alias("n"), at_first.alias("f"))
    is_start = F.col("block") == 0
    blocks = blocks.select(
        "file", "block", F.when(is_start, F.col("f.place")).alias("start"), F.col("f.place").alias("place"),
        (F.col("n") + F.when(is_start, F.col("f.n_first") - F.col("f.n")).otherwise(0)).alias("n"),
    )
    if blocks.count() > MOST_SPLITS:
        raise ValueError("too many splits; raise spark.sql.files.maxPartitionBytes")
    before = (Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(*before)
    task = F.shiftright("place", 33)
    in_task = Window.partitionBy(task).orderBy("place").rowsBetween(*before)
    # A row's number, counted through its task, less those of the splits before it there.
    base = F.shiftleft(task, 33) + F.coalesce(F.sum("n").over(in_task), F.lit(0))
    blocks = blocks.select(
        "file", "block", "start", (F.coalesce(F.sum("n").over(in_file), F.lit(0)) - base).alias("shift")
    )
    is_first = "place <=> start"
    documents = records.join(F.broadcast(blocks), ["file", "block"]).selectExpr(
        "file", "shift", f"explode(CASE WHEN {is_first} THEN {first} ELSE {other} END) AS chunk"
    )
    name = F.element_at(F.split("file", "/"), -1)
    return documents.withColumn("number", F.monotonically_increasing_id()).select(
        F.regexp_replace(_decoded(name), r"\.[^.]*$", "").alias("corpus_id"),
        (F.col("number") + F.col("shift")).cast("int").alias("doc_index"),
        F.expr(wrapped("chunk")).alias("text"),
    )


def _fields(lines: DataFrame, schema: T.StructType, sep: str) -> DataFrame:
    """``lines`` (keys and ``value``) with the fields of each line in place of it."""
    parsed = F.from_csv("value", schema.simpleString()[len("struct<") : -1].replace(":", " "), {"sep": sep})
    return lines.withColumn("line", parsed).select(
        *[c for c in lines.columns if c != "value"], "line.*"
    )


def letter_gold_from_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, value`` with a line ``start;last;type`` each, as gold spans."""
    return _fields(lines, LETTER_GOLD, ";").withColumn("end", F.col("end") + 1)


def case_gold_from_lines(lines: DataFrame) -> DataFrame:
    """``doc_id, value`` with a line ``start,end + 1,label,type`` each, as gold spans."""
    return _fields(lines, CASE_GOLD, ",").withColumn("end", F.col("end") - 1)


def scores_from_lines(lines: DataFrame) -> DataFrame:
    """``config_name, value`` with a line of the score table each, as scores."""
    return _fields(lines, SCORES, ",")


def _gold_lines(spark: SparkSession, path: str) -> DataFrame:
    doc_id = F.regexp_extract(_file_name(), r"^(.*?)_?anon\.csv", 1)
    lines = spark.read.option("pathGlobFilter", "*anon.csv").text(path)
    return lines.select(doc_id.alias("doc_id"), "value").filter("trim(value) <> ''")


def read_letter_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans ``start;last;type`` from ``<doc_id>_anon.csv`` files."""
    return letter_gold_from_lines(_gold_lines(spark, path))


def read_case_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold spans ``start,end + 1,label,type`` from ``<doc_id>_anon.csv`` files."""
    return case_gold_from_lines(_gold_lines(spark, path))


def document_order() -> Column:
    """Sort key of ``doc_id``: the digits in it as one number of any length, as its number
    of digits and the digits. Ids without digits come first."""
    digits = F.regexp_replace(F.regexp_replace("doc_id", "[^0-9]", ""), "^0+(?=[0-9])", "")
    return F.struct(F.length(digits).alias("n_digits"), digits.alias("digits"))


def letter_gold_lines(gold: DataFrame) -> DataFrame:
    """Gold spans as ``doc_id`` and one ``start;last;type`` line each."""
    line = F.concat_ws(";", "start", F.col("end") - 1, "entity_type")
    return gold.select("doc_id", line.alias("value"))


def case_gold_lines(gold: DataFrame) -> DataFrame:
    """Gold spans as ``doc_id`` and one ``start,end + 1,label,type`` line each."""
    line = F.concat_ws(",", "start", F.col("end") + 1, "bio_label", "entity_type")
    return gold.select("doc_id", line.alias("value"))


def write_letter_gold(gold: DataFrame, path: str) -> None:
    """Gold spans as lines ``start;last;type``, one folder ``doc_id=<id>`` a document."""
    lines = gold.repartition("doc_id").sortWithinPartitions("doc_id", "start")
    letter_gold_lines(lines).write.partitionBy("doc_id").text(path)


def record_json(record: Column, fmt: str) -> Column:
    """One sentence record as JSON: its text and ``[start, end + 1, label]`` per
    label. Format ``jsonl`` escapes what is not ASCII."""
    if fmt not in RECORD_FORMATS:
        raise ValueError(f"record format must be one of {RECORD_FORMATS}, not {fmt!r}")
    options = {"writeNonAsciiCharacterAsCodePoint": str(fmt == "jsonl").lower()}

    def quoted(value):
        as_array = F.to_json(F.array(value), options)
        return F.substring(as_array, F.lit(2), F.length(as_array) - 2)

    def label(x):
        # Most tags need no escapes, and most labels have all three parts.
        tag = F.when(x["tag"].rlike(PLAIN), F.concat(F.lit('"'), x["tag"], F.lit('"')))
        parts = (x["start"], x["end"] + 1, F.coalesce(tag, quoted(x["tag"])))
        whole = F.concat(F.lit("["), parts[0], F.lit(", "), parts[1], F.lit(", "), parts[2], F.lit("]"))
        return F.coalesce(whole, F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")))

    labels = F.transform(record["labels"], label)
    return F.concat(
        F.lit('{"text": '),
        quoted(record["text"]),
        F.lit(', "labels": ['),
        F.array_join(labels, ", "),
        F.lit("]}"),
    )


def records_json(records: Column, fmt: str) -> Column:
    """All records of a document: a JSON array, or one record per line."""
    lines = F.transform(records, lambda r: record_json(r, fmt))
    if fmt == "jsonl":
        return F.array_join(lines, "\n")
    return F.concat(F.lit("["), F.array_join(lines, ", "), F.lit("]"))


def write_sentence_records(records: DataFrame, path: str, fmt: str = "json") -> None:
    """Write ``doc_id, records`` as one JSON or JSON-lines text per document, under
    ``doc_id=<id>``. For corpora of very many documents write the nested table to
    parquet instead."""
    records.select("doc_id", records_json(F.col("records"), fmt).alias("value")).write.partitionBy(
        "doc_id"
    ).text(path)


def read_sentence_records(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Sentence records as ``doc_id, records``. The id is that of the partition
    folder, or the file name without its extension."""
    if fmt not in RECORD_FORMATS:
        raise ValueError(f"record format must be one of {RECORD_FORMATS}, not {fmt!r}")
    files = spark.read.text(path, wholetext=True)
    in_name = F.regexp_extract(_file_name(), r"^(.*?)(?:\.jsonl?)?$", 1)
    doc_id = F.col("doc_id").cast("string") if "doc_id" in files.columns else in_name
    return files.select(doc_id.alias("doc_id"), records_from_json(F.col("value"), fmt).alias("records"))


def records_from_json(value: Column, fmt: str) -> Column:
    """The records of a document from its JSON or JSON-lines text."""
    if fmt not in RECORD_FORMATS:
        raise ValueError(f"record format must be one of {RECORD_FORMATS}, not {fmt!r}")
    if fmt == "jsonl":
        lines = F.filter(F.split(value, "\n"), lambda line: F.trim(line) != "")
        value = F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    return F.transform(
        F.from_json(value, RECORDS),
        lambda r: F.struct(
            r["text"].alias("text"),
            F.transform(
                r["labels"],
                lambda x: F.struct(
                    F.get(x, F.lit(0)).cast("int").alias("start"),
                    (F.get(x, F.lit(1)).cast("int") - 1).alias("end"),
                    F.get(x, F.lit(2)).alias("tag"),
                ),
            ).alias("labels"),
        ),
    )


def write_gold_corpus(corpus: DataFrame, path: str, per_document: bool = False) -> None:
    """Write the texts, masked texts and gold spans of a gold corpus below ``path``.

    As tables (parquet, and one CSV table with ``doc_id`` in front), or with
    ``per_document`` as one text, one masked text and one headerless CSV per
    document under ``doc_id=<id>``, which suits small corpora only."""
    spans = corpus.selectExpr("doc_id", rows("gold")).select(
        "doc_id", "start", (F.col("end") + 1).alias("end"), "bio_label", "entity_type"
    )
    texts = corpus.select("doc_id", "text")
    masked = corpus.select("doc_id", F.col("masked_text").alias("text"))
    if per_document:
        texts.write.partitionBy("doc_id").text(f"{path}/texts")
        masked.write.partitionBy("doc_id").text(f"{path}/masked")
        spans.repartition("doc_id").sortWithinPartitions("doc_id", "start").write.partitionBy(
            "doc_id"
        ).csv(f"{path}/gold")
    else:
        texts.write.parquet(f"{path}/texts")
        masked.write.parquet(f"{path}/masked")
        spans.write.csv(f"{path}/gold")


def write_scores(scores: DataFrame, path: str) -> None:
    """Write score tables as CSV with a header, one folder per configuration. What was
    there for the same configurations is replaced, other configurations stay."""
    scores.select(*SCORES.names, "config_name").repartition("config_name").write.partitionBy(
        "config_name"
    ).mode("overwrite").option("partitionOverwriteMode", "dynamic").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score tables written by ``write_scores``."""
    schema = T.StructType([*SCORES.fields, T.StructField("config_name", T.StringType())])
    return spark.read.schema(schema).csv(path, header=True)


def read_score_files(spark: SparkSession, path: str) -> DataFrame:
    """All ``<config>_scores.csv`` files of a folder, in one scan. Their first column
    is a row index; the configuration is the file name up to its last ``_``."""
    return (
        spark.read.schema(INDEXED_SCORES)
        .option("pathGlobFilter", "*_scores.csv")
        .csv(path, header=True)
        .select(
            *SCORES.names,
            F.regexp_extract(_file_name(), "^(.*)_[^_]*$", 1).alias("config_name"),
        )
    )
