"""Models built one after another, each once, checked, and given to those that follow."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..session import written


@dataclass(frozen=True)
class Model:
    build: Callable[[dict[str, DataFrame]], DataFrame]
    table: bool = False
    checks: tuple[Callable[[DataFrame], DataFrame], ...] = field(default=())


class FailedCheck(RuntimeError):
    """A check returned rows, so what follows its model isn't built."""


def build(sources: dict[str, DataFrame], models: dict[str, Model]) -> dict[str, DataFrame]:
    """All ``models`` in their order; tables are written and read back, the others stay lazy."""
    done = dict(sources)
    for name, model in models.items():
        df = model.build(done)
        done[name] = written(df, name) if model.table else df
        for check in model.checks:
            if bad := check(done[name]).take(5):
                raise FailedCheck(f"{name}: {bad}")
    return done
