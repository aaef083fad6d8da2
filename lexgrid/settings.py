"""Settings of a service over the engine: defaults, overridden by the environment, overridden by the session."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import SparkSession

PREFIX, WIDTH = "lexgrid.", 1024


@dataclass(frozen=True)
class Settings:
    """The defaults. ``store_url`` may be empty; otherwise it must be https and loses its last slashes."""

    environment: str = "local"
    store_url: str = ""
    embedding_dimensions: int = WIDTH
    embedding_requests_per_minute: int = 3
    embedding_tokens_per_minute: int = 10_000
    llm_max_tokens: int = 800
    llm_temperature: float = 0.1
    match_threshold: float = 0.3
    vector_match_count: int = 5
    keyword_match_count: int = 5
    default_language: str = "en"
    rate_limit_per_minute: int = 10
    rate_limit_per_day: int = 200

    def __post_init__(self) -> None:
        if self.environment not in ("local", "staging", "production"):
            raise ValueError(f"environment: {self.environment}")
        if self.store_url and not self.store_url.startswith("https://"):
            raise ValueError("store_url must start with https://")
        if self.embedding_dimensions != WIDTH:
            raise ValueError(f"embedding_dimensions must be {WIDTH}, the width of stored vectors")
        object.__setattr__(self, "store_url", self.store_url.rstrip("/"))


def settings(spark: SparkSession | None = None, environ: Mapping[str, str] = os.environ) -> Settings:
    """Values from the environment (LEXGRID_MATCH_THRESHOLD, ...) and the session (lexgrid.match_threshold, ...); blank ones count as unset."""
    found = {}
    for f in fields(Settings):
        value = environ.get(f"{PREFIX}{f.name}".replace(".", "_").upper())
        value = spark.conf.get(PREFIX + f.name, value) if spark else value
        if value:
            found[f.name] = type(f.default)(value)
    return Settings(**found)
