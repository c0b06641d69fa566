"""Named queries over the given tables, each with the SQL that defines its result where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return add


def part(name: str, body: str, *needs: str) -> None:
    """A named subquery that oracle texts can build on."""
    _PARTS[name] = (body, needs)


def using(select: str, *needs: str) -> str:
    """SQL text of a select over the named parts."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for n in _PARTS[name][1]:
            visit(n)
        order.append(name)

    for n in needs:
        visit(n)
    heads = ",\n".join(f"{n} AS MATERIALIZED ({_PARTS[n][0]})" for n in order)
    return f"WITH {heads}\n{select}"
