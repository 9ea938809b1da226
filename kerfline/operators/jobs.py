"""End-to-end jobs put together from the operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from kerfline.operators import fusion, models, records


@dataclass(frozen=True)
class Member:
    """A source's fitted models, best first, and their error in validation, which is also their weight in fusion."""

    modality: str
    fitted: tuple[tuple[PipelineModel, dict[str, float]], ...]
    mae: float


def predicted(features: DataFrame, member: Member) -> DataFrame:
    """A source's feature rows with the mean of its models as ``y_pred`` and their spread and error as ``sigma``."""
    names = [f"_m{i}" for i in range(len(member.fitted))]
    rows = features
    for name, (model, held) in zip(names, member.fitted, strict=True):
        rows = models.predict(rows, model, held, name)
    return models.uncertainty(rows, names, member.mae).drop(*names)


def predict_and_fuse(sources: dict[str, DataFrame], members: tuple[Member, ...], key: str = "fusion") -> DataFrame:
    """Feature rows ``record_name, features...`` of each source to one fused prediction a record, with what follows from sigma and, where a truth is known, from it."""
    bundles = None
    for member in members:
        one = records.bundle(predicted(sources[member.modality], member), member.modality, member.mae, key)
        bundles = one if bundles is None else bundles.unionByName(one)
    return records.with_truth(fusion.fuse(bundles, len(members)), sigma=True)
