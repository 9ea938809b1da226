"""Settings: files put over one another, single values set and read by dotted names, and settings of an earlier run replayed."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import SparkSession


def load(spark: SparkSession, path: str) -> dict[str, Any]:
    """A JSON file (YAML, if that library is there) from any store that Spark reads."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML settings need the yaml library") from e
        found = yaml.safe_load(text)
    else:
        found = json.loads(text)
    return found or {}


def merged(base: dict[str, Any], *over: dict[str, Any]) -> dict[str, Any]:
    """Later settings win, table by table; nothing given is changed."""
    out = dict(base)
    for other in over:
        for k, v in other.items():
            out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def flat(settings: dict[str, Any], before: str = "") -> dict[str, Any]:
    """Every value, tables among them, under its dotted name."""
    out: dict[str, Any] = {}
    for k, v in settings.items():
        out[before + str(k)] = v
        if isinstance(v, dict):
            out |= flat(v, f"{before}{k}.")
    return out


def read(settings: dict[str, Any], name: str, default: Any = None) -> Any:
    """The value of that dotted name; the default where there is none."""
    return flat(settings).get(name, default)


# Words that stand for values, in any case.
WORDS = {"true": True, "yes": True, "false": False, "no": False, "null": None, "none": None, "~": None}


def value_of(text: str) -> Any:
    """A word's value, a number, what JSON makes of it, or the text itself."""
    if text.strip().lower() in WORDS:
        return WORDS[text.strip().lower()]
    for form in (json.loads, float):
        try:
            return form(text)
        except ValueError:
            continue
    return text


def with_values(settings: dict[str, Any], assignments: list[str]) -> dict[str, Any]:
    """Settings with ``a.b=value`` put in, dashes before the name aside; a name alone is a flag that is set."""
    for assignment in assignments:
        name, sign, text = assignment.lstrip("-").partition("=")
        value = value_of(text) if sign else True
        for part in reversed(name.strip().split(".")):
            value = {part: value}
        settings = merged(settings, value)
    return settings


def replayed(name: str, *sources: dict[str, Any] | None, default: Any = None) -> Any:
    """A value from the first of the sources that has it: a bundle, its metadata, the run's settings, the file."""
    missing = object()
    for source in sources:
        found = read(source or {}, name, missing)
        if found is not missing and found is not None:
            return found
    return default


# How strongly column names speak for one or the other extractor.
VOTES = {
    "v2": ((3, ("wpd_", "mfcc_", "dmfcc_", "ddmfcc_", "td_", "ss_", "br_", "tf_", "cx_")),),
    "v1": ((2, ("dwt_", "spectral_", "st_", "peak_freq_", "peak_mag_", "band_power_", "ratio_")),),
}
SINGLE = ("crest_factor", "waveform_length", "percentile_95")


def extractor(columns: list[str]) -> str | None:
    """The extractor version that made a feature table, by weighted votes of its columns; None on a tie."""
    names = [c.strip().lower() for c in columns]
    votes = {v: sum(w for w, prefixes in rules for c in names if c.startswith(prefixes)) for v, rules in VOTES.items()}
    votes["v2"] += 2 * sum(c[:5] == "cwt_s" and c[5:6].isdigit() for c in names)
    votes["v1"] += sum(c in SINGLE for c in names)
    best = max(votes.values())
    first = [v for v, n in votes.items() if n == best]
    return first[0] if len(first) == 1 else None
