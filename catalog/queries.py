"""One query per operator, over whole tables."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import velum
from catalog import inputs as I
from velum.functions import finders
from velum.functions.arrays import rows
from velum.functions.dates import generalise, normalise_months
from velum.operators import annotations, models, scoring, spans
from velum.plans.gold import gold_from_corpora, gold_rows
from velum.sources import files

def _flat(df: DataFrame, *others: str) -> DataFrame:
    """Span rows with column names that need no quoting in SQL."""
    start, end = (F.col(c).cast("long").alias(f"span_{c}") for c in ("start", "end"))
    return df.select("doc_id", start, end, *others)


def find(finder, spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = I.corpus(spark, sf_dir).selectExpr("doc_id", rows(finder("text")))
    return _flat(hits, "text")


def find_date_valid(spark, sf_dir):
    dates = finders.find_dates("text", I.REFERENCE_DATE)
    return _flat(I.corpus(spark, sf_dir).selectExpr("doc_id", rows(dates)), "text")


def date_generalise(level, spark, sf_dir):
    read = rows(finders.find_readings("text", I.REFERENCE_DATE))
    hits = I.corpus(spark, sf_dir).selectExpr("doc_id", read)
    return _flat(hits.withColumn("shown", F.expr(generalise("date", level))), "text", "shown")


def months_normalised(spark, sf_dir):
    return I.letters(spark, sf_dir).selectExpr(
        "doc_id", f"{normalise_months('lower(text)')} AS text"
    )


def found(merge, spark, sf_dir):
    df = velum.find_spans(I.corpus(spark, sf_dir), I.config(I.REGEX_CONFIG), merge)
    return _flat(df, "entity_type", "text", "model")


def resolved_stored_spans(spark, sf_dir):
    stored = velum.find_spans(I.corpus(spark, sf_dir), I.config(I.REGEX_CONFIG))
    return _flat(spans.resolve_spans(stored), "entity_type", "text", "model")


def masked(spark, sf_dir, **mask):
    return velum.deidentify(
        I.corpus(spark, sf_dir), I.config(I.REGEX_CONFIG, **mask), merge=True
    ).select("doc_id", "masked_text")


def remask_stored_spans(spark, sf_dir):
    docs = I.corpus(spark, sf_dir)
    stored = velum.find_spans(docs, I.config(I.REGEX_CONFIG))
    return velum.remask(docs, stored, I.config(I.REGEX_CONFIG, mode="tag_l", special_character="-"))


def deidentify(spark, sf_dir):
    """Masked text with the number of found and of kept spans."""
    docs = I.corpus(spark, sf_dir)
    cfg = I.config(I.REGEX_CONFIG, mode="anon_l")
    return velum.deidentify(docs, cfg).select(
        "doc_id", "masked_text", F.size("spans").cast("long").alias("n_spans")
    )


def gold_from_inline_tags(spark, sf_dir):
    gold = annotations.gold_from_inline_tags(I.letters_tagged(spark, sf_dir))
    return _flat(gold, "entity_type")


def letter_gold_lines(spark, sf_dir):
    gold = annotations.gold_from_inline_tags(I.letters_tagged(spark, sf_dir))
    return files.letter_gold_lines(gold).withColumnRenamed("value", "line")


def span_text(spark, sf_dir):
    gold = spans.span_text(I.letters_gold(spark, sf_dir), I.letters(spark, sf_dir))
    return _flat(gold, "entity_type", "text")


def corpus_split(spark, sf_dir):
    return annotations.split_corpus(I.raw_corpora(spark, sf_dir))


def conll_tokens(spark, sf_dir):
    tokens = annotations.token_rows(I.token_texts(spark, sf_dir))
    return _flat(tokens, "sent_id", "pos", "word", "tag")


def token_offsets(spark, sf_dir):
    tokens = annotations.token_rows(I.token_texts(spark, sf_dir))
    return _flat(tokens.filter(F.col("tag") != "O"), "sent_id", "word", "tag")


def _records(spark, sf_dir):
    records = annotations.sentence_records(I.token_texts(spark, sf_dir))
    return records.selectExpr("doc_id", "posexplode(array_compact(records)) AS (sent_id, r)")


def sentence_records(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "doc_id", "sent_id", "r.text", F.size("r.labels").cast("long").alias("n_labels")
    )


def sentence_json(spark, sf_dir):
    return _records(spark, sf_dir).select(
        "doc_id", "sent_id", files.record_json(F.col("r"), "json").alias("record")
    )


def _gold_corpora(spark, sf_dir):
    """The whole chain from raw corpora on."""
    corpus = gold_from_corpora(I.raw_corpora(spark, sf_dir))
    return corpus.withColumn("doc_id", F.concat_ws("-", "corpus_id", "doc_index"))


def bio_runs(spark, sf_dir):
    return _flat(gold_rows(_gold_corpora(spark, sf_dir)), "bio_label", "entity_type")


def annotation_mask(spark, sf_dir):
    return _gold_corpora(spark, sf_dir).select("doc_id", "text", "masked_text")


def letter_gold_parsed(spark, sf_dir):
    """Gold lines written and read again."""
    gold = annotations.gold_from_inline_tags(I.letters_tagged(spark, sf_dir))
    return _flat(files.letter_gold_from_lines(files.letter_gold_lines(gold)), "entity_type")


def case_gold_parsed(spark, sf_dir):
    lines = files.case_gold_lines(gold_rows(_gold_corpora(spark, sf_dir)))
    return _flat(files.case_gold_from_lines(lines), "bio_label", "entity_type")


def records_parsed(fmt, spark, sf_dir):
    """Sentence records of a document as one text and back."""
    records = annotations.sentence_records(I.token_texts(spark, sf_dir))
    texts = records.select("doc_id", files.records_json(F.col("records"), fmt).alias("value"))
    back = texts.select("doc_id", files.records_from_json(F.col("value"), fmt).alias("records"))
    rows = back.selectExpr("doc_id", "posexplode(array_compact(records)) AS (sent_id, r)")
    return rows.select("doc_id", "sent_id", "r.text", F.size("r.labels").cast("long").alias("n_labels"))


def document_order(spark, sf_dir):
    """Every text with its place in the order by document number."""
    order = files.document_order()
    return (
        I.documents(spark, sf_dir)
        .select("doc_id", order["digits"].cast("long").alias("doc_number"))
        .orderBy(order)
    )


def model_span_intake(spark, sf_dir):
    taken = models.intake_spans(
        I.model_spans(spark, sf_dir), I.config(I.MIXED_CONFIG), inclusive_end=("john",)
    )
    return _flat(taken, "entity_type", "text", "model")


ANNOTATED_CONFIG = {"models": {"organization": "stanza", "date": "regex"}}


def annotate_models(spark, sf_dir):
    """The stand-in for a model takes runs of capital letters as organisations."""

    def capital_words():
        pattern = re.compile("[A-Z]{2,}")
        return lambda text: [(*m.span(), "ORG", m.group()) for m in pattern.finditer(text)]

    df = velum.find_spans(
        I.corpus(spark, sf_dir), I.config(ANNOTATED_CONFIG), annotators={"stanza": capital_words}
    )
    return _flat(df, "entity_type", "text", "model")


def _with_exclusive_ends(raw):
    last = F.when(F.col("model") == "john", 1).otherwise(0)
    return raw.withColumn("end", F.col("end") + last)


def deidentify_with_models(spark, sf_dir):
    return velum.deidentify(
        I.letters(spark, sf_dir),
        I.config(I.MIXED_CONFIG, mode="tag"),
        merge=True,
        model_spans=_with_exclusive_ends(I.model_spans(spark, sf_dir)),
        span_models=I.REPORTING,
    ).select("doc_id", "masked_text")


def deidentify_with_models_all(spark, sf_dir):
    """Masked text and number of different spans found, patterns and models together."""
    return velum.deidentify(
        I.letters(spark, sf_dir),
        I.config(I.MIXED_CONFIG, mode="tag"),
        model_spans=_with_exclusive_ends(I.model_spans(spark, sf_dir)),
        span_models=I.REPORTING,
    ).select("doc_id", "masked_text", F.size("spans").cast("long").alias("n_spans"))


def _reports(cfg, spark, sf_dir):
    """The table of model spans, where a configuration uses models."""
    if not cfg.model_entities:
        return {}
    return {"model_spans": _with_exclusive_ends(I.model_spans(spark, sf_dir)), "span_models": I.REPORTING}


def _scored(values, spark, sf_dir):
    """Predicted and gold spans of the letters."""
    cfg = I.config(values)
    with_models = _reports(cfg, spark, sf_dir)
    predicted = velum.find_spans(I.letters(spark, sf_dir), cfg, **with_models)
    return (
        scoring.to_gold_labels(predicted),
        scoring.fold_gold(I.letters_gold(spark, sf_dir)),
    )


def gold_labels(spark, sf_dir):
    """Predicted and gold spans in one label space."""
    predicted, gold = _scored(I.REGEX_CONFIG, spark, sf_dir)
    return _flat(predicted, "entity_type").withColumn("side", F.lit("predicted")).unionByName(
        _flat(gold, "entity_type").withColumn("side", F.lit("gold"))
    )


def confusion(kind, spark, sf_dir):
    predicted, gold = _scored(I.REGEX_CONFIG, spark, sf_dir)
    count = scoring.confusion_strict if kind == "strict" else scoring.confusion_lenient
    return count(predicted, gold)


def _rounded(df: DataFrame, names=scoring.METRICS) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def scores_document(spark, sf_dir):
    return _rounded(scoring.scores_document(*_scored(I.REGEX_CONFIG, spark, sf_dir)))


def _evaluated(values, spark, sf_dir, merge=False, doc_id=None):
    cfg = I.config(values)
    letters, gold = I.letters(spark, sf_dir), I.letters_gold(spark, sf_dir)
    return velum.evaluate(letters, gold, cfg, merge, doc_id=doc_id, **_reports(cfg, spark, sf_dir))


def scores_macro(merge, spark, sf_dir):
    return _rounded(_evaluated(I.REGEX_CONFIG, spark, sf_dir, merge))


def scores_one_document(spark, sf_dir):
    """Scores of the one letter that is asked for."""
    return _rounded(_evaluated(I.REGEX_CONFIG, spark, sf_dir, doc_id=I.ONE_LETTER))


def score_lines_parsed(spark, sf_dir):
    """Score lines written and read again."""
    scores = _evaluated(I.REGEX_CONFIG, spark, sf_dir)
    line = F.to_csv(F.struct(*files.SCORES.names))
    return _rounded(files.scores_from_lines(scores.select("config_name", line.alias("value"))))


def scores_partial_gold(spark, sf_dir):
    """Gold for some letters only, and some of it without a letter."""
    return _rounded(
        velum.evaluate(I.letters(spark, sf_dir), I.partial_gold(spark, sf_dir), I.config(I.REGEX_CONFIG))
    )


def _all_scores(spark, sf_dir):
    configs = [I.config(c) for c in (I.REGEX_CONFIG, I.DATES_CONFIG, I.MIXED_CONFIG)]
    reports = _with_exclusive_ends(I.model_spans(spark, sf_dir))
    return velum.evaluate_all(
        I.letters(spark, sf_dir), I.letters_gold(spark, sf_dir), configs,
        model_spans=reports, span_models=I.REPORTING,
    )


def scores_all_configs(spark, sf_dir):
    return _rounded(scoring.ordered(_all_scores(spark, sf_dir), "f1", "lenient"))


def scores_compare(spark, sf_dir):
    configs = ["dates", "mixed", "regex"]
    compared = scoring.compare(_all_scores(spark, sf_dir), "f1", "lenient", configs)
    return _rounded(compared, configs)


def score_matrix(spark, sf_dir):
    return _rounded(scoring.score_matrix(_evaluated(I.MIXED_CONFIG, spark, sf_dir), "strict"))


def unpaired_documents(spark, sf_dir):
    """Texts without gold spans, and gold spans without a text."""
    return scoring.unpaired(I.corpus(spark, sf_dir), I.partial_gold(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "find_telephone": partial(find, finders.find_telephone),
    "find_zipcode": partial(find, finders.find_zipcode),
    "find_email": partial(find, finders.find_email),
    "find_fiscal_code": partial(find, finders.find_fiscal_code),
    "find_age": partial(find, finders.find_age),
    "find_date_candidates": partial(find, finders.find_date_candidates),
    "find_date_valid": find_date_valid,
    "months_normalised": months_normalised,
    "date_generalise_year": partial(date_generalise, "year"),
    "date_generalise_month": partial(date_generalise, "month"),
    "all_spans": partial(found, False),
    "resolved_spans": partial(found, True),
    "resolved_stored_spans": resolved_stored_spans,
    "mask_tag": partial(masked, mode="tag"),
    "mask_tag_l": partial(masked, mode="tag_l"),
    "mask_anon": partial(masked, mode="anon", special_character="x"),
    "mask_anon_l": partial(masked, mode="anon_l"),
    "mask_date_year": partial(masked, mode="anon_l", date_level="year"),
    "mask_date_month": partial(masked, mode="tag", date_level="month"),
    "remask_stored_spans": remask_stored_spans,
    "deidentify": deidentify,
    "gold_from_inline_tags": gold_from_inline_tags,
    "letter_gold_lines": letter_gold_lines,
    "span_text": span_text,
    "corpus_split": corpus_split,
    "conll_tokens": conll_tokens,
    "token_offsets": token_offsets,
    "sentence_records": sentence_records,
    "sentence_json": sentence_json,
    "bio_runs": bio_runs,
    "annotation_mask": annotation_mask,
    "letter_gold_parsed": letter_gold_parsed,
    "case_gold_parsed": case_gold_parsed,
    "records_parsed_json": partial(records_parsed, "json"),
    "records_parsed_jsonl": partial(records_parsed, "jsonl"),
    "document_order": document_order,
    "model_span_intake": model_span_intake,
    "annotate_models": annotate_models,
    "deidentify_with_models": deidentify_with_models,
    "deidentify_with_models_all": deidentify_with_models_all,
    "gold_labels": gold_labels,
    "confusion_strict": partial(confusion, "strict"),
    "confusion_lenient": partial(confusion, "lenient"),
    "scores_document": scores_document,
    "scores_one_document": scores_one_document,
    "scores_macro": partial(scores_macro, False),
    "scores_macro_resolved": partial(scores_macro, True),
    "score_lines_parsed": score_lines_parsed,
    "scores_partial_gold": scores_partial_gold,
    "scores_all_configs": scores_all_configs,
    "scores_compare": scores_compare,
    "score_matrix": score_matrix,
    "unpaired_documents": unpaired_documents,
}
