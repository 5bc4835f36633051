"""Named steps over a DataFrame, and registries of what can be plugged in."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

Step = Callable[[DataFrame, dict], DataFrame]


@dataclass
class Steps:
    """Steps in order; each gets the rows and a context shared by all.  A step
    that can't be planned stops the run, is left out (``continue``) or is tried
    again (``retry``)."""

    on_error: str = "stop"
    retries: int = 1
    steps: list[tuple[str, Step]] = field(default_factory=list)
    failed: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, step: Step, at: int | None = None) -> Steps:
        self.steps.insert(len(self.steps) if at is None else at, (name, step))
        return self

    def remove(self, name: str) -> Steps:
        self.steps = [s for s in self.steps if s[0] != name]
        return self

    def run(self, rows: DataFrame, context: dict | None = None) -> DataFrame:
        context = {} if context is None else context
        for name, step in self.steps:
            for attempt in range(1 + self.retries * (self.on_error == "retry")):
                try:
                    rows = step(rows, context)
                    self.failed.pop(name, None)
                    break
                except Exception as error:
                    self.failed[name] = str(error)
                    if self.on_error == "stop" or self.on_error == "retry" and attempt == self.retries:
                        raise
        return rows


@dataclass
class Registry:
    """Names to values, with a default: providers, strategies, token counters."""

    entries: dict = field(default_factory=dict)
    default: str | None = None

    def register(self, name: str, value) -> Registry:
        self.entries[name] = value
        self.default = self.default or name
        return self

    def get(self, name: str | None = None):
        return self.entries.get(name or self.default)

    def names(self) -> list[str]:
        return sorted(self.entries)
