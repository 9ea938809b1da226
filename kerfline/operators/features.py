"""Feature extraction from array columns: one row a record in, a map of features out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerfline.functions import dsp

BANDS = ((0.5, 4.0), (4.0, 8.0), (8.0, 16.0), (16.0, 24.0), (24.0, 32.0))

#: What is taken of each window, with statistics over the windows and differences of the cepstrum from window to window.
WINDOWED: dict[str, Callable] = {
    "hjorth": lambda x, sr: dsp.hjorth(x), "shape": dsp.spectral_shape, "band_ratios": lambda x, sr: dsp.band_ratios(x, sr, BANDS), "packet": lambda x, sr: dsp.haar_packet(x, 3),
    "cepstrum": lambda x, sr: {f"cc_{i}": v for i, v in enumerate(dsp.cepstrum(x, sr).T)}, "complexity": lambda x, sr: {"permen": dsp.permutation_entropy(x, 3)},
}

FAMILIES: dict[str, Callable] = {
    "time": dsp.time_features,
    "frequency": lambda x, sr: dsp.frequency_features(x, sr),
    "statistics": lambda x, sr: dsp.statistics(x),
    "short_time": lambda x, sr: dsp.short_time(x, 16, 8),
    "time_frequency": lambda x, sr: dsp.time_frequency(x, sr, 16, 8),
    "hjorth": lambda x, sr: dsp.hjorth(x),
    "shape": dsp.spectral_shape,
    "band_ratios": lambda x, sr: dsp.band_ratios(x, sr, BANDS),
    "dwt": lambda x, sr: dsp.wavelet_features(x),
    "machining": lambda x, sr: dsp.machining(x, sr, env_sr=sr, hf_sr=sr),
    "scalogram": lambda x, sr: dsp.scalogram_features(x, sr, 12, 1, low=sr / 64),
    "windowed": lambda x, sr: {f"w_{k}": v for k, v in dsp.windowed(x, sr, 32, 16, WINDOWED).items()},
    "packet": lambda x, sr: dsp.haar_packet(x, 3),
    "cepstrum": lambda x, sr: {f"cc_{i}": v for i, v in enumerate(dsp.cepstrum(x, sr).T)},
    "complexity": lambda x, sr: {"sampen": dsp.sample_entropy(x), "permen": dsp.permutation_entropy(x), "lz": dsp.lempel_ziv(x)},
    "wavelet": lambda x, sr: {f"cwt_{i}": v for i, v in enumerate(dsp.morlet_power(x, np.geomspace(2, max(4, x.shape[1] / 4), 12)).T)},
}


ROWS = 128  # records that go through the kernels as one matrix


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``ROWS`` rows: kernels hold many copies of their matrix, and Spark's batches may have ten thousand rows."""
    for batch in batches:
        yield from (batch.slice(s, ROWS) for s in range(0, batch.num_rows, ROWS))


def extract(signals: DataFrame, key: str, y: str, sr: float, families: tuple[str, ...] = tuple(FAMILIES)) -> DataFrame:
    """``key, features map<string,double>, error string``: a record that fails says why instead of going missing.

    Records of one length in a piece of a batch go through the kernels as one matrix. Values that are not finite are left out of the map."""
    unknown = set(families) - set(FAMILIES)
    if unknown:
        raise ValueError(f"unknown families: {sorted(unknown)}")
    schema = f"{key} {signals.schema[key].dataType.simpleString()}, features map<string,double>, error string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            rows = [np.array(v.as_py() if v.is_valid else [], dtype=float) for v in batch.column(1)]
            found: list = [None] * len(rows)
            errors: list = [None] * len(rows)
            for n in {len(r) for r in rows}:
                at = [i for i, r in enumerate(rows) if len(r) == n]
                try:
                    if n < 3:
                        raise ValueError(f"{n} samples are too few")
                    x = np.stack([rows[i] for i in at])
                    with np.errstate(all="ignore"):
                        columns = {k: v for f in families for k, v in FAMILIES[f](x, sr).items()}
                    for j, i in enumerate(at):
                        found[i] = [(k, float(v[j])) for k, v in columns.items() if np.isfinite(v[j])]
                except (ValueError, FloatingPointError, np.linalg.LinAlgError) as e:
                    for i in at:
                        errors[i] = str(e)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.map_(pa.string(), pa.float64())), pa.array(errors, pa.string())], names=[key, "features", "error"])

    return signals.select(key, F.col(y).cast("array<double>")).mapInArrow(run, schema)


def long(features: DataFrame, key: str) -> DataFrame:
    return features.select(key, F.explode("features").alias("feature", "value"))


def images(signals: DataFrame, key: str, y: str, sr: float, length: int, hop: int, **form) -> DataFrame:
    """``key, bands, frames, image``: each signal's front-end image by rows, as ``dsp.spectrogram_image`` makes it; signals shorter than a frame have none."""
    schema = f"{key} {signals.schema[key].dataType.simpleString()}, bands int, frames int, image array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.array(v.as_py() if v.is_valid else [], float) for v in batch.column(1)]
            made = [dsp.spectrogram_image(r[None], sr, length, hop, **form)[0] if len(r) >= length else np.zeros((0, 0)) for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.shape[0] for m in made], pa.int32()), pa.array([m.shape[1] for m in made], pa.int32()), pa.array([m.ravel().astype("f4") for m in made], pa.list_(pa.float32()))], names=[key, "bands", "frames", "image"])

    return signals.select(key, F.col(y).cast("array<double>")).mapInArrow(run, schema)
