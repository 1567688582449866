"""From documents to found spans and masked texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.config import DeidConfig, check_models
from velum.functions.arrays import empty
from velum.functions.finders import SPAN, pattern_spans
from velum.functions.mask import mask
from velum.functions.resolve import resolve
from velum.operators import detection
from velum.operators.models import annotate, intake, intake_spans
from velum.operators.spans import (
    distinct_per_document,
    flatten,
    resolve_spans,
    starts_per_document,
)


def _factories(config: DeidConfig, annotators: dict | None) -> dict:
    return {m: f for m, f in (annotators or {}).items() if m in config.model_entities}


def _patterns(config: DeidConfig, merge: bool = False) -> Column:
    """All spans that patterns find in a row, or with ``merge`` those resolution keeps."""
    if not config.pattern_entities:
        return F.expr(empty(SPAN))
    return detection.pattern_spans(
        F.col("text"), config.pattern_entities, config.reference_date, merge
    )


def _found(
    documents: DataFrame, config: DeidConfig, annotators: dict | None, bucketed: bool = False
) -> tuple[DataFrame, str]:
    """Documents, and the expression for the array of all spans found in a row. Where the
    texts may be bucketed patterns stay expressions: what a Python function has read is not
    known to be bucketed any more."""
    factories = _factories(config, annotators)
    if bucketed:
        documents = documents.select("doc_id", "text")
        patterns = pattern_spans("text", config.pattern_entities, config.reference_date)
    else:
        documents = documents.select("doc_id", "text", _patterns(config).alias("patterns"))
        patterns = "patterns"
    if not factories:
        return documents, patterns
    annotated = documents.withColumn("annotations", annotate(F.col("text"), factories))
    return annotated, f"concat({patterns}, {intake('annotations', config)})"


def _masked(config: DeidConfig) -> str:
    masked = mask(
        "text",
        "kept",
        config.mode,
        config.special_character,
        config.date_level,
        config.reference_date,
    )
    return f"{masked} AS masked_text"


def find_spans(
    documents: DataFrame,
    config: DeidConfig,
    merge: bool = False,
    annotators: dict | None = None,
    model_spans: DataFrame | None = None,
    skip_models: tuple[str, ...] = (),
    span_models: tuple[str, ...] = (),
) -> DataFrame:
    """All found spans, one per row; with ``merge`` only those that resolution keeps.

    Model spans come from ``annotators`` (model name -> factory, run in place) or from
    ``model_spans``, a table of raw spans computed elsewhere by the models that
    ``span_models`` names. A model of the configuration that has neither raises, unless
    ``skip_models`` names it."""
    check_models(config, annotators, model_spans, skip_models, span_models)
    if model_spans is None and not _factories(config, annotators):
        patterns = _patterns(config, merge).alias("patterns")
        return flatten(documents.select("doc_id", patterns), "patterns")
    documents, spans = _found(documents, config, annotators)
    if model_spans is None:
        return flatten(documents, resolve(spans) if merge else spans)
    both = flatten(documents, spans).unionByName(intake_spans(model_spans, config))
    return resolve_spans(both) if merge else both


def deidentify(
    documents: DataFrame,
    config: DeidConfig,
    merge: bool = False,
    annotators: dict | None = None,
    model_spans: DataFrame | None = None,
    skip_models: tuple[str, ...] = (),
    span_models: tuple[str, ...] = (),
) -> DataFrame:
    """``doc_id``, ``masked_text`` and ``spans`` of each document.

    Without ``model_spans`` this is a projection: no shuffle, and it also runs on a
    stream. ``spans`` are all found spans, or with ``merge`` the kept ones. Of equal spans
    in a table of model spans one is given here; ``find_spans`` has every copy."""
    check_models(config, annotators, model_spans, skip_models, span_models)
    if model_spans is None and config.pattern_entities and not _factories(config, annotators):
        masked = detection.masked(F.col("text"), config, merge).alias("masked")
        return documents.select("doc_id", masked).select("doc_id", "masked.masked_text", "masked.spans")
    documents, spans = _found(documents, config, annotators, bucketed=model_spans is not None)
    found = documents.selectExpr("doc_id", "text", f"{spans} AS spans")
    if model_spans is not None:
        taken = intake_spans(model_spans, config)
        others = starts_per_document(taken) if merge else distinct_per_document(taken)
        found = found.join(others, "doc_id", "left").selectExpr(
            "doc_id", "text", f"concat(spans, coalesce(candidates, {empty(SPAN)})) AS spans"
        )
    resolved = found.selectExpr("doc_id", "text", "spans", f"{resolve('spans')} AS kept")
    return resolved.selectExpr(
        "doc_id", _masked(config), f"{'kept' if merge else 'spans'} AS spans"
    )


def remask(documents: DataFrame, spans: DataFrame, config: DeidConfig) -> DataFrame:
    """Mask documents again from a stored span table, without detection. Spans are
    gathered by document, at most one a start, and resolved in the row. Bucket both tables
    by ``doc_id`` and the texts stay where they are."""
    return (
        documents.select("doc_id", "text")
        .join(starts_per_document(spans), "doc_id", "left")
        .selectExpr("doc_id", "text", f"{resolve(f'coalesce(candidates, {empty(SPAN)})')} AS kept")
        .selectExpr("doc_id", _masked(config))
    )
