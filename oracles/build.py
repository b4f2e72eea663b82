"""Assemble one statement from named common table expressions."""
from __future__ import annotations

import re

CTES: dict[str, str] = {}


def define(**ctes: str) -> None:
    CTES.update(ctes)


def _needs(sql: str) -> set[str]:
    return {w for w in re.findall(r"[a-z_][a-z0-9_]*", sql) if w in CTES}


def statement(sql: str, doubles: str = "") -> str:
    """``WITH`` exactly the expressions the statement uses; round the named columns."""
    if sql.lstrip().startswith("WITH"):
        sql = f"SELECT * FROM ({sql})"
    order: list[str] = []

    def visit(name: str) -> None:
        for n in sorted(_needs(CTES[name]) - {name}):
            if n not in order:
                visit(n)
        if name not in order:
            order.append(name)

    for n in sorted(_needs(sql)):
        visit(n)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in order)
    if doubles:
        rounded = ", ".join(f"round({c}, 6) AS {c}" for c in doubles.split())
        sql = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
    return f"WITH {head}\n{sql}" if head else sql


def variant(end: str, **changed: str) -> None:
    """Copies, with names that end in ``end``, of the given expressions with other texts, and of
    all that depend on them. A changed text names the originals."""
    reach = set(changed)
    while True:
        more = {n for n, sql in CTES.items() if n not in reach and _needs(sql) & reach}
        if not more:
            break
        reach |= more

    def renamed(sql: str) -> str:
        return re.sub(r"[a-z_][a-z0-9_]*", lambda m: m[0] + end if m[0] in reach else m[0], sql)

    define(**{n + end: changed.get(n) or renamed(CTES[n]) for n in reach})
