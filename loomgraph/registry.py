"""Parsers by file suffix: the built-in ones, those a caller brings, and families that this installation lacks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from importlib.util import find_spec
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from .sources import parsers


class Parser(Protocol):
    """What a parser is: rows of facts of one file, as the built-in ones collect them."""

    name: str
    version: str
    suffixes: tuple[str, ...]

    def parse(self, f: parsers.Facts, path: str, text: str) -> None: ...


@dataclass(frozen=True)
class BuiltIn:
    name: str
    suffixes: tuple[str, ...]
    version: str = parsers.PARSER_VERSION

    def parse(self, f: parsers.Facts, path: str, text: str) -> None:
        getattr(parsers, self.name)(f, path, text)


@dataclass(frozen=True)
class Family:
    """Parsers that need a module which may not be there."""

    name: str
    module: str
    suffixes: tuple[str, ...]
    instead: str

    def available(self) -> bool:
        return find_spec(self.module) is not None


@dataclass(frozen=True)
class Selection:
    parser: Parser | None
    omitted: tuple[dict, ...] = ()


OPTIONAL = (Family("script_precise", "tree_sitter", parsers.SUFFIXES["script"], "script"),)


@dataclass(frozen=True)
class Registry:
    parsers: Sequence[Parser]
    optional: Sequence[Family] = field(default=OPTIONAL)

    def select(self, path: str) -> Selection:
        """The first parser whose suffixes fit; and a note where a better one isn't installed."""
        lost = tuple({"reason": "optional_parser_unavailable", "item_id": path, "details": {"family": f.name, "instead": f.instead}} for f in self.optional if path.endswith(f.suffixes) and not f.available())
        return Selection(next((p for p in self.parsers if path.endswith(tuple(p.suffixes))), None), lost)

    def with_parsers(self, more: Iterable[Parser]) -> Registry:
        """The caller's parsers come first."""
        return Registry((*more, *self.parsers), self.optional)

    def parse(self, f: parsers.Facts, path: str, text: str) -> None:
        got = self.select(path)
        if got.parser is not None:
            got.parser.parse(f, path, text)
        for o in got.omitted:
            f.omit(o["reason"], o["item_id"], **o["details"])


def default() -> Registry:
    return Registry([BuiltIn(name, parsers.SUFFIXES[name]) for name in ("python", "script", "markdown", "config")])


def support(spark: SparkSession, registry: Registry | None = None) -> DataFrame:
    """family, suffixes, status (available or missing), version: sorted by family."""
    r = registry or default()
    rows = [(p.name, " ".join(p.suffixes), "available", p.version) for p in r.parsers] + [(f.name, " ".join(f.suffixes), "available" if f.available() else "missing", "") for f in r.optional]
    return spark.createDataFrame(sorted(rows), "family string, suffixes string, status string, version string")
