"""Configuration: which detector serves each entity, and how spans are masked."""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass, field, replace
from types import MappingProxyType

from velum.labels import ENTITIES, MODEL_LABELS, PATTERN_RANK

MASK_MODES = ("tag", "tag_l", "anon", "anon_l")
DATE_LEVELS = ("hide", "year", "month")


@dataclass(frozen=True)
class DeidConfig:
    """Values a plan is built from. ``models`` maps an entity to ``'regex'``, to the
    name of an entity-recognition model, or to ``''`` for off."""

    models: MappingProxyType = field(
        default_factory=lambda: MappingProxyType({e: "" for e in ENTITIES})
    )
    mode: str = "tag"
    special_character: str = "*"
    date_level: str = "hide"
    reference_date: dt.date = field(default_factory=dt.date.today)
    name: str | None = None

    def __post_init__(self):
        check_mode(self.mode)
        check_date_level(self.date_level)
        if not self.special_character:
            raise ValueError("special_character must not be empty")
        for entity, backend in self.models.items():
            if backend not in ("", "regex") and backend not in MODEL_LABELS:
                raise ValueError(f"unknown detector {backend!r} for {entity}")
            if backend == "regex" and entity not in PATTERN_RANK:
                raise ValueError(f"no pattern exists for {entity}")
            if backend in MODEL_LABELS and entity not in MODEL_LABELS[backend].values():
                raise ValueError(f"{backend} has no label for {entity}")

    @classmethod
    def from_dict(cls, cfg: dict, base: DeidConfig | None = None, reference_date=None):
        """Read a configuration; what it does not name stays as in ``base``."""
        base = base or cls()
        models = dict(base.models)
        models.update({e: m for e, m in cfg.get("models", {}).items() if e in ENTITIES})
        mask = cfg.get("mask", {})
        character = mask.get("special_character", base.special_character)
        return replace(
            base,
            models=MappingProxyType(models),
            mode=mask.get("mode", base.mode),
            special_character=character[:1],
            date_level=mask.get("date_level", base.date_level),
            reference_date=reference_date or base.reference_date,
            name=cfg.get("name", base.name),
        )

    @classmethod
    def from_json(cls, path: str, base: DeidConfig | None = None, reference_date=None):
        with open(path, encoding="utf-8") as source:
            return cls.from_dict(json.load(source), base, reference_date)

    @property
    def pattern_entities(self) -> list[str]:
        """Entities found by pattern, in rank order."""
        return [e for e in PATTERN_RANK if self.models[e] == "regex"]

    @property
    def model_entities(self) -> dict[str, list[str]]:
        """Entities served by each model that is in use."""
        return {
            model: served
            for model in MODEL_LABELS
            if (served := [e for e in ENTITIES if self.models[e] == model])
        }


def check_models(
    config: DeidConfig, annotators, model_spans, skip: tuple[str, ...], span_models: tuple[str, ...] = ()
) -> None:
    """Every model in use needs an annotator, or a table of spans that is said to have its
    spans, or must be named as one to do without: else its entities would stay in the text
    unnoticed. What a table holds does not tell: a model may have found nothing."""
    if isinstance(span_models, str) or isinstance(skip, str):
        raise ValueError("models are named in a list, not in a string")
    if span_models and model_spans is None:
        raise ValueError(f"no table with the spans of {', '.join(sorted(span_models))}")
    given = set(annotators or ()) | set(skip) | set(span_models)
    missing = sorted(set(config.model_entities) - given)
    if missing:
        raise ValueError(
            f"no annotator and no spans for {', '.join(missing)}; name the models of a table of spans"
            " in span_models, or those to do without in skip_models"
        )


def check_mode(mode: str) -> None:
    if mode not in MASK_MODES:
        raise ValueError(f"mask mode must be one of {MASK_MODES}, not {mode!r}")


def check_date_level(level: str) -> None:
    if level not in DATE_LEVELS:
        raise ValueError(f"date level must be one of {DATE_LEVELS}, not {level!r}")
