"""Settings of a database, from keyword arguments or the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from keystrata.sources.errors import ConfigError


@dataclass(frozen=True)
class Config:
    """Sizes count entries, not bytes."""

    data_directory: str = "data"
    memtable_size: int = 10_000
    level_0_size: int = 15
    block_size: int = 4096
    max_frozen_memtables: int = 2

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "data_directory":
                if not isinstance(value, str) or not value:
                    raise ConfigError("data_directory must not be empty")
            elif isinstance(value, bool) or not isinstance(value, int) or value < 1:
                raise ConfigError(f"{f.name} must be an integer above 0")

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, prefix: str = "KEYSTRATA_") -> Config:
        """KEYSTRATA_MEMTABLE_SIZE and so on; what is not set keeps its default."""
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is None:
                continue
            try:
                given[f.name] = text if f.name == "data_directory" else int(text)
            except ValueError:
                raise ConfigError(f"{prefix}{f.name.upper()}: {text!r} is no integer") from None
        return cls(**given)
