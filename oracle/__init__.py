"""DuckDB SQL that gives the expected rows of every query over the same tables.

``PARTS`` are named sub-queries; ``QUERIES`` are the final selections.  A query's
SQL is a WITH list of the fixture views and parts it mentions.
"""

from __future__ import annotations

import re

from loreweave import fixtures
from oracle.parts import PARTS
from oracle.queries import QUERIES

_NAME = re.compile(r"\b([vc]_\w+)\b")


def _text(name: str) -> str:
    return PARTS[name] if name in PARTS else fixtures.sql_text(name, "duckdb")


def _needs(text: str, order: list[str], open_: frozenset[str] = frozenset()) -> None:
    """Append to ``order`` the parts that ``text`` needs, each after its own needs."""
    for name in _NAME.findall(text):
        if name in order or name in open_ or not (name in PARTS or name in fixtures.VIEW_NAMES):
            continue
        _needs(_text(name), order, open_ | {name})
        order.append(name)


def sql(key: str) -> str:
    order: list[str] = []
    _needs(QUERIES[key], order)
    if not order:
        return QUERIES[key]
    body = ",\n".join(f"{name} as (\n{_text(name)}\n)" for name in order)
    recursive = "recursive " if any(n.startswith("c_rec_") for n in order) else ""
    return f"with {recursive}{body}\n{QUERIES[key]}"


def all_sql() -> dict[str, str]:
    return {key: sql(key) for key in QUERIES}
