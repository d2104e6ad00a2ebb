"""Settings as dataclasses, with a YAML file merged over the defaults."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any


@dataclass
class DataConfig:
    report_lag_days: int = 45
    text_lag_business_days: int = 1
    macro_lag_days: int = 10


@dataclass
class WindowConfig:
    train: int = 240
    validation: int = 60
    test: int = 30
    step: int = 30


@dataclass
class ModelConfig:
    alphas: tuple[float, ...] = (0.1, 1.0, 10.0)
    horizon: int = 1
    quantile_z: float = 1.2816


@dataclass
class Config:
    data: DataConfig = field(default_factory=DataConfig)
    windows: WindowConfig = field(default_factory=WindowConfig)
    model: ModelConfig = field(default_factory=ModelConfig)


def merge(config: Any, values: dict) -> Any:
    """``values`` set over a dataclass, level by level; unknown names are an error."""
    known = {f.name for f in fields(config)}
    for k, v in values.items():
        if k not in known:
            raise KeyError(k)
        old = getattr(config, k)
        setattr(config, k, merge(old, v) if is_dataclass(old) else tuple(v) if isinstance(old, tuple) else type(old)(v))
    return config


def load_config(path: str | None = None) -> Config:
    if not path:
        return Config()
    import yaml

    with open(path, encoding="utf-8") as f:
        return merge(Config(), yaml.safe_load(f) or {})
