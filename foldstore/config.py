"""Configuration of a store."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from foldstore.functions.codec import require_name

LOG_LEVELS = ("error", "warn", "info", "debug", "trace")


@dataclass(frozen=True)
class StoreConfig:
    """account, store and the names of its key fields; partitions of its log; options for readers and writers."""

    account: str
    store: str
    primary_key: str
    partitioning_key: str = ""
    partitions: int = 1
    path: str = ""
    options: dict[str, Any] = field(default_factory=dict)

    def __post_init__(self):
        for name in ("account", "store", "primary_key"):
            require_name(getattr(self, name), name)
        if self.partitions < 1:
            raise ValueError("a store has one partition at least")
        if not self.partitioning_key:
            object.__setattr__(self, "partitioning_key", self.primary_key)
        level = self.options.get("log_level")
        if level is not None and str(level).lower() not in LOG_LEVELS:
            raise ValueError(f"log_level is one of {', '.join(LOG_LEVELS)}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> StoreConfig:
        return cls(**json.loads(text))


class ConfigBuilder:
    """Chained setters for a configuration."""

    def __init__(self, account: str, store: str, primary_key: str):
        self._values: dict[str, Any] = {"account": account, "store": store, "primary_key": primary_key}
        self._options: dict[str, Any] = {}

    def partitioned_by(self, name: str, partitions: int) -> ConfigBuilder:
        self._values |= {"partitioning_key": require_name(name, "partitioning_key"), "partitions": partitions}
        return self

    def at(self, path: str) -> ConfigBuilder:
        self._values["path"] = require_name(path, "path")
        return self

    def option(self, name: str, value: Any) -> ConfigBuilder:
        self._options[require_name(name, "option")] = value
        return self

    def build(self) -> StoreConfig:
        return StoreConfig(**self._values, options=dict(self._options))


def merge_options(server: dict[str, Any], client: dict[str, Any]) -> dict[str, Any]:
    """Server options overlaid by client options. A name keeps one type: a client value of another type is an error."""
    for name in server.keys() & client.keys():
        if type(server[name]) is not type(client[name]):
            raise TypeError(f"{name} is {type(server[name]).__name__} on the server")
    return {**server, **client}
