"""Run configuration: defaults, validation, and TOML files."""

from __future__ import annotations

import copy
import os
import tomllib
from collections.abc import Callable, Iterable, Iterator

from ..operators.projection import PROJECTIONS
from ..sources.registry import names

SCALING = ("rms", "hard_barrier", "softplus_barrier", "mean_distance")
INITS = ("random", "pca")
#: Starting values of every setting.
DEFAULTS = {
    "data": {"dataset": "embeddings", "n_samples": 1000},
    "embedding": {
        "embed_dim": 2, "n_iterations": 1000, "init_method": "pca", "perplexity": 30.0, "early_exaggeration_iterations": 250,
        "early_exaggeration_factor": 12.0, "momentum_early": 0.5, "momentum_main": 0.8, "centering_weight": 0.0, "scaling_loss_type": "hard_barrier",
    },
    "hyperparameters": {"learning_rates": {"k": 200.0}, "init_scale": "auto"},
    "experiments": {"curvatures": [-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5, 2.0]},
    "evaluation": {"n_neighbors": 5},
    "visualization": {"spherical_projection": "orthographic"},
}


def defaults() -> dict:
    """A copy of the starting values that may be changed freely."""
    return copy.deepcopy(DEFAULTS)


def _number(x: object) -> bool:
    return isinstance(x, int | float) and not isinstance(x, bool)


def _numbers(x: object) -> bool:
    return bool(x) and isinstance(x, list) and all(map(_number, x))


def _whole(least: int, *others: int) -> tuple[Callable[[object], bool], str]:
    said = f"must be a whole number from {least} on" + "".join(f", or {o}" for o in others)
    return lambda x: isinstance(x, int) and not isinstance(x, bool) and (x >= least or x in others), said


def _one_of(choices: Iterable[str]) -> tuple[Callable[[object], bool], str]:
    choices = list(choices)
    return lambda x: x in choices, f"must be one of {', '.join(choices)}"


_POSITIVE = (lambda x: _number(x) and x > 0, "must be positive")
_SHARE = (lambda x: _number(x) and 0 <= x <= 1, "must be from 0 to 1")
#: What a value has to be: section, setting, test and what to say; ``?`` marks settings that may be missing.
RULES = (
    ("data", "dataset", *_one_of(names())),
    ("data", "n_samples?", *_whole(1, -1)),
    ("embedding", "embed_dim", *_whole(1)),
    ("embedding", "init_method", *_one_of(INITS)),
    ("embedding", "scaling_loss_type", *_one_of(SCALING)),
    ("embedding", "n_iterations", *_whole(1)),
    ("embedding", "early_exaggeration_iterations", *_whole(0)),
    ("embedding", "early_exaggeration_factor", *_POSITIVE),
    ("embedding", "perplexity", *_POSITIVE),
    ("embedding", "momentum_early", *_SHARE),
    ("embedding", "momentum_main", *_SHARE),
    ("embedding", "centering_weight", lambda x: _number(x) and x >= 0, "must not be negative"),
    ("experiments", "curvatures", _numbers, "must be a list of numbers"),
    ("hyperparameters", "learning_rates", lambda x: isinstance(x, dict) and all(map(_POSITIVE[0], x.values())), "must be positive numbers by curvature"),
    ("visualization?", "spherical_projection", *_one_of(PROJECTIONS)),
)


def validate(config: dict) -> tuple[bool, str]:
    """(ok, message): the first rule that the configuration breaks."""
    try:
        return next(((False, said) for said in _faults(config)), (True, "ok"))
    except Exception as e:  # noqa: BLE001  any malformed value is a finding
        return False, f"Validation error: {e}"


def _faults(config: dict) -> Iterator[str]:
    for section, key, good, said in RULES:
        name, setting = section.rstrip("?"), key.rstrip("?")
        if name not in config:
            if section == name:
                yield f"section {name} is missing"
        elif not (setting not in config[name] and key != setting) and not good(config[name].get(setting)):
            yield f"{setting} {said}, not {config[name].get(setting)!r}"
    steps = config["embedding"]
    if steps["early_exaggeration_iterations"] >= steps["n_iterations"]:
        yield "early_exaggeration_iterations must be less than n_iterations"


def learning_rate(config: dict, k: float) -> float:
    """The rate of a curvature: its own, the general one (k), or 200."""
    rates = config["hyperparameters"]["learning_rates"]
    return float(rates.get(str(k), rates.get("k", 200.0)))


def load(path: str) -> dict:
    """The configuration in a TOML file on the driver; the file is made from the defaults where there is none."""
    if not os.path.exists(path):
        save(defaults(), path)
    with open(path, "rb") as f:
        return tomllib.load(f)


def _toml(value: object) -> str:
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return '"' + value.replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'
    if isinstance(value, list):
        return "[" + ", ".join(map(_toml, value)) + "]"
    if isinstance(value, dict):
        return "{" + ", ".join(f"{_toml(str(k))} = {_toml(v)}" for k, v in value.items()) + "}"
    return repr(value)


def save(config: dict, path: str) -> None:
    lines = []
    for section, values in config.items():
        lines += [f"[{section}]", *(f"{k} = {_toml(v)}" for k, v in values.items()), ""]
    with open(path, "w") as f:
        f.write("\n".join(lines))
