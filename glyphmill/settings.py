"""Rules by which settings are found: the first of several places that has a value."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any


def overlaid(defaults: dict[str, Any], overrides: dict[str, Any]) -> dict[str, Any]:
    """Overrides over defaults, group by group."""
    both = {k: v for k, v in defaults.items() if k not in overrides}
    for k, v in overrides.items():
        inner = defaults.get(k)
        both[k] = overlaid(inner, v) if isinstance(v, dict) and isinstance(inner, dict) else v
    return both


def first_of(settings: dict[str, Any], *places: str, default: Any = None) -> Any:
    """The value of the first dotted place that has one."""
    for place in places:
        at: Any = settings
        for part in place.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if at is not None:
            return at
    return default


def seed(settings: dict[str, Any]) -> int:
    return int(first_of(settings, "seed", "training.seed", default=42))


def subsample_seed(settings: dict[str, Any]) -> int:
    return int(first_of(settings, "eval_subsample_seed", default=seed(settings)))


def max_samples(settings: dict[str, Any]) -> int | None:
    n = first_of(settings, "benchmarks.max_samples", "max_samples")
    return None if n is None else int(n)


def data_sources(exists: Callable[[str], bool], prepared: str, train: str | None, validation: str | None) -> tuple[str | None, str | None]:
    """Training and validation data: shuffled samples if there are any, else the given tables. Packed but unshuffled samples are an error."""
    if exists(f"{prepared}/train_shuffled"):
        train = f"{prepared}/train_shuffled"
    elif exists(f"{prepared}/train_packed"):
        raise FileNotFoundError(f"{prepared} holds packed samples that have not been shuffled")
    return train, f"{prepared}/val_packed" if exists(f"{prepared}/val_packed") else validation


def dumped(settings: dict[str, Any]) -> str:
    """Settings as JSON with sorted keys, for a run's record."""
    return json.dumps(settings, sort_keys=True, ensure_ascii=False, indent=1, default=str)
