"""Spans of entity-recognition models: running a model and taking its spans in."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.config import DeidConfig
from velum.functions.arrays import literal, literal_map
from velum.labels import ENTITIES, MODEL_LABELS, MODEL_RANK, OUTPUT_LABEL

ANNOTATION = "struct<start:int,end:int,label:string,text:string,model:string>"

# A factory loads a model and returns a function from one text to its spans as
# (start, end, label, text), with exclusive ends. A factory given to ``batched`` returns a
# function from a list of texts to a list with the spans of each.
Found = Iterable[tuple[int, int, str, str]]
Annotator = Callable[[str], Found] | Callable[[list[str]], list[Found]]

MOST_MODELS = 8
_LOADED: dict[tuple[str, str], Annotator] = {}


@dataclass(frozen=True)
class Batched:
    """A factory whose model takes up to ``size`` texts at a time."""

    factory: Callable[[], Annotator]
    size: int

    def __call__(self) -> Annotator:
        return self.factory()


def batched(factory: Callable[[], Annotator], size: int = 64) -> Batched:
    """Mark a factory whose model works on lists of texts. Texts of a list differ."""
    if size < 1:
        raise ValueError("a batch has one text or more")
    return Batched(factory, size)


def loaded_model(model: str, key: str, factory: Callable[[], Annotator]) -> Annotator:
    """A model of this worker process, by its name and what its factory is, so that other
    plans with the same factory find it. Of more than ``MOST_MODELS`` those unused for the
    longest time make room."""
    found = _LOADED.pop((model, key), None)
    if found is None:
        found = factory()
    _LOADED[model, key] = found
    for other in list(_LOADED)[:-MOST_MODELS]:
        del _LOADED[other]
    return found


def _found_in(texts: list[str], annotator: Annotator, size: int | None) -> dict[str, list]:
    """The spans of each text."""
    if size is None:
        return {t: list(annotator(t)) for t in texts}
    found = {}
    for at in range(0, len(texts), size):
        part = texts[at : at + size]
        spans = list(annotator(part))
        if len(spans) != len(part):
            raise ValueError(f"a model gave {len(spans)} results for {len(part)} texts")
        found.update(zip(part, map(list, spans)))
    return found


def annotate(text: Column, factories: dict[str, Callable[[], Annotator]]) -> Column:
    """Run models over a text column, all in one pass.

    Only the text goes to the Python worker and only spans come back. Each model is
    loaded once per worker, also over several plans, and sees equal texts of a batch
    once."""
    keys = {m: hashlib.sha256(cloudpickle.dumps(f)).hexdigest() for m, f in factories.items()}

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        loaded = {m: loaded_model(m, keys[m], factory) for m, factory in factories.items()}
        for texts in batches:
            different = list(dict.fromkeys(t for t in texts if t is not None))
            spans: dict[str, list] = {t: [] for t in different}
            for model, annotator in loaded.items():
                found = _found_in(different, annotator, getattr(factories[model], "size", None))
                for t, of_text in found.items():
                    spans[t] += [
                        {"start": s, "end": e, "label": label, "text": covered, "model": model}
                        for s, e, label, covered in of_text
                    ]
            yield pd.Series([spans[t] if t is not None else [] for t in texts], dtype=object)

    return F.pandas_udf(run, f"array<{ANNOTATION}>")(text)


def _entity(label: str, model: str, config: DeidConfig) -> str:
    """Entity of a raw model label if the configuration gives that entity to the
    model, else NULL."""
    routed = {
        f"{m}/{raw}": entity
        for m, served in config.model_entities.items()
        for raw, entity in [*MODEL_LABELS[m].items(), *((e, e) for e in ENTITIES)]
        if entity in served
    }
    if not routed:
        return "cast(NULL AS string)"
    return f"try_element_at({literal_map(routed)}, concat_ws('/', {model}, {label}))"


def intake(annotations: str, config: DeidConfig) -> str:
    """Annotations of one row as spans: labels harmonised, entities selected, ranked.
    A model's position among the annotations is kept as ``seq``."""
    spans = (
        f"transform({annotations}, (a, i) -> named_struct('start', a.start, 'end', a.`end`, "
        f"'rank', {literal_map(MODEL_RANK)}[a.model], 'seq', i, "
        f"'entity_type', {literal_map(OUTPUT_LABEL)}[{_entity('a.label', 'a.model', config)}], "
        "'text', a.text, 'model', a.model))"
    )
    return f"filter({spans}, s -> s.entity_type IS NOT NULL)"


def intake_spans(
    raw: DataFrame, config: DeidConfig, inclusive_end: tuple[str, ...] = ()
) -> DataFrame:
    """A table of raw model spans (``doc_id, start, end, label, text, model`` and
    optionally ``seq``) as a span table. Models named in ``inclusive_end`` give the
    last covered position instead of the end."""
    last_models = ", ".join(map(literal, inclusive_end)) or "NULL"
    return (
        raw.withColumn("entity", F.expr(_entity("label", "model", config)))
        .filter("entity IS NOT NULL")
        .selectExpr(
            "doc_id",
            "cast(start AS int) AS start",
            f"cast(`end` + CASE WHEN model IN ({last_models}) THEN 1 ELSE 0 END AS int) AS `end`",
            f"{literal_map(MODEL_RANK)}[model] AS rank",
            "cast(seq AS int) AS seq" if "seq" in raw.columns else "0 AS seq",
            f"{literal_map(OUTPUT_LABEL)}[entity] AS entity_type",
            "text",
            "model",
        )
    )
