"""Building a gold corpus from token/BIO texts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from velum.functions.arrays import rows
from velum.labels import BIO_KEEP, CORPUS_MARKER
from velum.operators.annotations import MIN_CHUNK, SEPARATORS, annotation_mask, split_corpus
from velum.operators.tokens import corpus_bodies


def gold_corpus(
    documents: DataFrame,
    sep: str = " ",
    keep: tuple[str, ...] = BIO_KEEP,
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keys, text, gold, masked_text`` of token/BIO documents. The text is the whole
    body between the dummy first and last sentence; blank lines in it do not count. A
    document without the two gives a row with null texts and no spans."""
    if sep not in SEPARATORS:
        raise ValueError(f"token separator must be one of {SEPARATORS}, not {sep!r}")
    return (
        documents.select(*keys, corpus_bodies("text", sep, tuple(keep)).alias("body"))
        .select(*keys, "body.text", "body.gold")
        .selectExpr(*keys, "text", "gold", f"{annotation_mask('text', 'gold')} AS masked_text")
    )


def gold_from_corpora(
    corpora: DataFrame,
    marker: str = CORPUS_MARKER,
    sep: str = " ",
    keep: tuple[str, ...] = BIO_KEEP,
    min_length: int = MIN_CHUNK,
) -> DataFrame:
    """Raw corpora (``corpus_id, text``) to ``corpus_id, doc_index, text, gold,
    masked_text``: cut into documents, read as tokens, runs of tags as spans, masked."""
    documents = split_corpus(corpora, marker, min_length)
    return gold_corpus(documents, sep, keep, ("corpus_id", "doc_index"))


def gold_rows(corpus: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per gold span of a gold corpus."""
    return corpus.selectExpr(*keys, rows("gold")).drop("rank", "seq")
