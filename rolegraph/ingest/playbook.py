"""Schema books: a text with a schema, hints and examples, compiled to a checked program of derivations.

A book has three fenced blocks: `schema` (derive statements), `aliases` (old = new, a line each) and
`examples` (programs that must pass the check against the schema).
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from rolegraph.check import verify
from rolegraph.lang import tree as T
from rolegraph.lang.canonical import show
from rolegraph.lang.parser import parse
from rolegraph.session import Session

_BLOCK = re.compile(r"```(schema|aliases|examples)\n(.*?)```", re.S)


@dataclass
class Plan:
    derive: list[T.Stmt] = field(default_factory=list)
    deprecate: list[str] = field(default_factory=list)
    aliases: dict[str, str] = field(default_factory=dict)

    def __str__(self) -> str:
        return "\n".join([show(s) for s in self.derive] + [f"deprecate {c}" for c in self.deprecate] + [f"{a} = {b}" for a, b in self.aliases.items()])


def plan(session: Session, book: str) -> Plan:
    """What the book would change; raises ProgramError where it doesn't hold together."""
    blocks = dict(_BLOCK.findall(book))
    if missing := {"schema", "aliases", "examples"} - set(blocks):
        raise T.ProgramError(f"the book lacks the blocks {', '.join(sorted(missing))}")
    stmts = parse(blocks["schema"])
    if strange := [s for s in stmts if not isinstance(s, (T.DeriveClass, T.DeriveEdge))]:
        raise T.ProgramError(f"line {strange[0].line} of the schema derives nothing")
    catalog = session.graph.catalog
    new = [s for s in stmts if s.name not in catalog.classes and s.name not in catalog.edges]
    verify(new, catalog)
    trial = catalog.copy()
    for s in new:
        if isinstance(s, T.DeriveClass):
            trial.add_class(s.name, dict(s.props), s.base, status="provisional", quota=s.quota or 500)
        else:
            trial.add_edge(s.name, dict(s.roles))
    verify(parse(blocks["examples"]), trial)
    aliases = dict(tuple(x.strip() for x in line.split("=", 1)) for line in blocks["aliases"].splitlines() if "=" in line)
    kept = {s.name for s in stmts}
    gone = [c.name for c in catalog.classes.values() if c.status == "provisional" and c.name not in kept]
    return Plan(new, gone, aliases)


def compile_book(session: Session, write: Callable[[str | None], str], confirm: Callable[[Plan], bool]) -> Plan | None:
    """Ask for a book (with the error of the first try, if it had one), confirm its changes, apply them."""
    from rolegraph.store.writes import deprecate_class

    error = None
    for _ in range(2):
        try:
            p = plan(session, write(error))
            break
        except T.ProgramError as e:
            error = str(e)
    else:
        raise T.ProgramError(f"the book doesn't pass: {error}")
    if not confirm(p):
        return None
    if p.derive:
        session.execute("\n".join(show(s) for s in p.derive))
    for c in p.deprecate:
        deprecate_class(session.graph, c)
    if p.aliases:
        session.graph.commit([{"op": "lineage", "kind": "playbook_link", "payload": json.dumps(p.aliases)}])
    return p
