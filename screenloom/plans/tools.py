"""Registry of knowledge-source builders: selection, dependency order, preflight, build, verification."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from screenloom.operators import knowledge as K
from screenloom.plans.runs import refuse_existing
from screenloom.sources import sinks


@dataclass(frozen=True)
class Tool:
    """A builder: (session, tables of its dependencies) -> DataFrame."""

    name: str
    build: Callable[[SparkSession, Mapping[str, DataFrame]], DataFrame]
    needs: tuple[str, ...] = ()


class Registry:
    def __init__(self, tools: Sequence[Tool]) -> None:
        self.tools = {t.name: t for t in tools}
        if len(self.tools) != len(tools):
            raise ValueError("tools of one name")

    def order(self, names: Sequence[str], with_needs: bool = True) -> list[str]:
        """The named tools, and what they need, each after its needs and otherwise in the order of the registry."""
        if unknown := sorted(set(names) - set(self.tools)):
            raise KeyError(f"unknown tools: {unknown}")
        if not with_needs:
            return [n for n in self.tools if n in names]
        wanted: dict[str, int] = {}

        def visit(name: str, above: tuple[str, ...]) -> int:
            """Depth of a tool: one more than that of its deepest need."""
            if name in above:
                raise ValueError(f"tools need each other: {[*above, name]}")
            if name not in wanted:
                wanted[name] = 1 + max((visit(n, (*above, name)) for n in self.tools[name].needs), default=0)
            return wanted[name]

        for n in names:
            visit(n, ())
        done: list[str] = []
        while len(done) < len(wanted):
            done.append(next(n for n in self.tools if n in wanted and n not in done and set(self.tools[n].needs) <= set(done)))
        return done

    def build(self, spark: SparkSession, names: Sequence[str], folder: str, overwrite: bool = False, with_needs: bool = True) -> dict[str, str]:
        """Write each tool's table to ``folder/name``; occupied targets are refused before anything is built."""
        order = self.order(names, with_needs)
        paths = {n: f"{folder}/{n}" for n in order}
        refuse_existing(spark, list(paths.values()), overwrite)
        for n in order:
            needed = {m: spark.read.parquet(f"{folder}/{m}") for m in self.tools[n].needs}
            sinks.write_table(self.tools[n].build(spark, needed), paths[n], overwrite)
        return paths


def verify(sources: Mapping[str, DataFrame], needed: Mapping[str, DataFrame], aliases: DataFrame, references: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """Per source: coverage of the keys that a dataset needs, and the difference to a reference if there is one."""
    from pyspark.sql import functions as F

    out = {}
    for name, source in sources.items():
        own = aliases.filter(F.col("source") == name)
        out[f"{name}.coverage"] = K.coverage(K.resolve_keys(needed[name], source, own))
        if references and name in references:
            out[f"{name}.reference"] = K.comparison_summary(source, references[name])
    return out
