"""Settings, from the environment where it has them."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from quarry.functions.identity import NAMESPACE
from quarry.functions.paths import COLLECTION_PREFIX


@dataclass
class Config:
    """Every field may be set by an environment variable of its name in upper case; a number that can't be read leaves the default."""

    active_embedder: str = "hash"
    embedding_model: str = "hash"
    embedding_url: str = ""
    embedding_dimensions: int = 3072
    api_key: str = ""
    store_path: str = "quarry-store"
    collection_prefix: str = COLLECTION_PREFIX
    id_namespace: str = NAMESPACE
    hash_algorithm: str = "sha256"
    cache_key: str = "model"
    path_match: str = "prefix"
    embed_batch_max_tokens: int = 8000
    embed_batch_max_items: int = 50
    max_retries: int = 5

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None, **over) -> Config:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            value = env.get(f.name.upper())
            if value is not None:
                try:
                    found[f.name] = type(f.default)(value)
                except ValueError:
                    continue
        return cls(**(found | {k: v for k, v in over.items() if v is not None}))
