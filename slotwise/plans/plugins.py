"""Extension points: discoveries, line scanners and mechanisms of one's own, named in the configuration by class path."""

from __future__ import annotations

import importlib
from typing import Protocol, runtime_checkable

from pyspark.sql import DataFrame


@runtime_checkable
class Discovery(Protocol):
    """Lines of a package to its log files; see ``sources.discovery.discovered`` for the columns."""

    def discover(self, lines: DataFrame) -> DataFrame: ...


@runtime_checkable
class LineScanner(Protocol):
    """Lines to entries, as column expressions or with ``mapInPandas``."""

    def scan(self, lines: DataFrame) -> DataFrame: ...


@runtime_checkable
class MechanismRunner(Protocol):
    """Lines and the declared earlier results to a result; ``validate`` raises for a configuration that can't work."""

    def validate(self, mechanism) -> None: ...

    def run(self, lines: DataFrame, mechanism, results: dict): ...


def load(path: str, kind: type):
    """An object of the class at ``package.module:Class``, which must offer what ``kind`` asks for."""
    module, _, name = path.partition(":")
    if not name:
        raise ValueError(f"a class path reads package.module:Class, not {path!r}")
    found = getattr(importlib.import_module(module), name, None)
    if not isinstance(found, type):
        raise ValueError(f"{path} is no class")
    made = found()
    if not isinstance(made, kind):
        raise TypeError(f"{path} is no {kind.__name__}")
    return made
