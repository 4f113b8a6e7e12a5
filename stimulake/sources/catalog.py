"""Catalog of models: cards, registration, lookup, and plug-in encoders."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidParameterError, ModelNotFoundError
from ..operators.select import check_keys, check_member

Encoder = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]


@dataclass
class Card:
    """What is known of a model. parameters: by name, with keys such as required, valid_values, default and example."""

    model_id: str
    modality: str
    dataset: str
    parameters: dict[str, dict[str, Any]] = field(default_factory=dict)
    selection_keys: tuple[str, ...] = ()
    #: (subject, selection) to the function that mapInPandas gets, and the schema of its rows.
    encoder: Callable[[Any, dict], tuple[Encoder, str]] | None = None
    #: Called with the plug-in when a model that made one is closed.
    cleanup: Callable[[tuple[Encoder, str]], None] | None = None


class Catalog:
    """Models by id; the last registration of an id holds."""

    def __init__(self) -> None:
        self._cards: dict[str, Card] = {}

    def register(self, card: Card) -> None:
        self._cards[card.model_id] = card

    def ids(self) -> list[str]:
        return list(self._cards)

    def card(self, model_id: str) -> Card:
        if model_id not in self._cards:
            raise ModelNotFoundError(f"no model {model_id!r}; there are {self.ids()}")
        return self._cards[model_id]

    def models(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(c.model_id, c.modality, c.dataset) for c in self._cards.values()], "model_id string, modality string, dataset string")

    def describe(self, model_id: str) -> dict[str, Any]:
        """The card as a dictionary; each parameter with the value to show: its example, else first valid value, else default."""
        c = self.card(model_id)
        shown = {name: next((v for v in (p.get("example"), next(iter(p.get("valid_values") or []), None), p.get("default")) if v is not None), "...") for name, p in c.parameters.items()}
        return {"model_id": c.model_id, "modality": c.modality, "dataset": c.dataset, "parameters": c.parameters, "selection_keys": list(c.selection_keys), "example": shown}

    def model(self, model_id: str, subject: Any, selection: dict | None = None) -> Model:
        """A model for one subject and selection, which must be among those of its card."""
        c = self.card(model_id)
        check_keys(selection or {}, c.selection_keys)
        if valid := c.parameters.get("subject", {}).get("valid_values"):
            check_member(subject, valid, "subject")
        return Model(c, subject, selection or {})

    def encode(self, model_id: str, stimuli: DataFrame, subject: Any, selection: dict | None = None) -> DataFrame:
        return self.model(model_id, subject, selection).encode(stimuli)

    def encode_with_metadata(self, model_id: str, stimuli: DataFrame, subject: Any, selection: dict | None = None) -> tuple[DataFrame, dict[str, Any]]:
        """Responses, and what is known of them."""
        m = self.model(model_id, subject, selection)
        return m.encode(stimuli), m.metadata()


@dataclass(frozen=True)
class Model:
    """A model with its subject and selection checked once; its plug-in is made when stimuli are first encoded, and kept until the model is
    closed, by ``close`` or at the end of a ``with`` block. A closed model makes a new one if it is used again."""

    card: Card
    subject: Any
    selection: dict

    @cached_property
    def _plug_in(self) -> tuple[Encoder, str]:
        if self.card.encoder is None:
            raise InvalidParameterError(f"{self.card.model_id!r} has no encoder")
        return self.card.encoder(self.subject, self.selection)

    def encode(self, stimuli: DataFrame) -> DataFrame:
        """Responses to stimuli: the plug-in runs on Arrow batches of each partition."""
        function, schema = self._plug_in
        return stimuli.mapInPandas(function, schema)

    def close(self) -> None:
        plug_in = self.__dict__.pop("_plug_in", None)
        if plug_in is not None and self.card.cleanup:
            self.card.cleanup(plug_in)

    def __enter__(self) -> Model:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def metadata(self) -> dict[str, Any]:
        """What is known of the responses; nothing is loaded."""
        return {"model_id": self.card.model_id, "modality": self.card.modality, "dataset": self.card.dataset, "subject": self.subject, "selection": self.selection}

    def accuracy(self, scores: DataFrame) -> DataFrame:
        """Rows of a table of unit scores that belong to this model and, where it has such a column, this subject: a pushed filter."""
        of = scores.where(F.col("model_id") == self.card.model_id) if "model_id" in scores.columns else scores
        return of.where(F.col("subject") == self.subject) if "subject" in scores.columns else of


def by_modality(models: DataFrame) -> DataFrame:
    """(modality, dataset) rows to the sorted distinct datasets of each modality."""
    return models.groupBy("modality").agg(F.array_sort(F.collect_set("dataset")).alias("datasets"))
