"""One spelling per program: two programs are the same query if their canonical texts are equal.

Every statement has a template over its fields; a format after a colon says how a field is spelled,
and fields that say nothing leave nothing.
"""

from __future__ import annotations

import string
from dataclasses import fields

from rolegraph.lang import tree as T
from rolegraph.lang.parser import parse

_TEMPLATES = {
    T.Find: "find {target}{cond:where}{order:order} as {name}",
    T.Follow: "follow {source} {edge} {role}{cond:where}{upto:steps} as {name}{optional:if or none}",
    T.Or: "or",
    T.GroupBy: "group by {path:path} as {name}",
    T.Aggregate: "{verb}{distinct:if distinct} {path:path} as {name}",
    T.Keep: "keep {name}{cond:where}",
    T.Compute: "compute {left:path} {op} {right:path} as {name}",
    T.Return: "return{distinct:if distinct} {cols:paths}{order:order}{limit:given limit}{budget:budget}{after:given after}",
    T.Continue: "continue {handle}{budget:budget}",
    T.ShowSchema: "schema",
    T.AssertNode: "assert {cls} {props:values}{source:given source} as {name}",
    T.AssertEdge: "assert edge {edge}{roles:roles}{source:given source}",
    T.Merge: "merge {a}, {b}{prefer:prefer}",
    T.Distinct: "distinct {a}, {b} reason {reason:value}",
    T.Refine: "refine {ref} into {cls} with {mapping:columns} as {name}",
    T.Compact: "compact {source} as {name} {props:values}",
    T.Retire: "retire {ref} reason {reason:value}",
    T.Flag: "flag {ref} reason {reason:value}",
    T.DeriveClass: "derive class {name} from {base} with {props:kinds}{quota:given quota}{dedup:given dedup}",
    T.DeriveEdge: "derive edge {name}{roles:roles}",
}


class _Spelling(string.Formatter):
    """The formats that templates use."""

    def format_field(self, value: object, spec: str) -> str:
        kind, _, word = spec.partition(" ")
        return getattr(self, kind)(value, word) if kind else str(value)

    def value(self, v: object, _: str = "") -> str:
        if v is T.ABSENT:
            return "none"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (int, float)):
            return repr(int(v) if v == int(v) else v)
        if str(v).startswith("attach:"):
            return str(v)
        return '"' + "".join("\\" + c if c in '\\"' else c for c in str(v)) + '"'

    def path(self, p: T.Path, _: str = "") -> str:
        return ".".join(p)

    def paths(self, ps: tuple[T.Path, ...], _: str = "") -> str:
        return ", ".join(map(self.path, ps))

    def where(self, cond: T.Cond, _: str = "") -> str:
        """Groups joined by or, their clauses by and."""
        clause = "{0.path:path} {0.op} {0.value:value}"
        groups = [" and ".join(self.format(clause, c) for c in group) for group in cond]
        return " where " + " or ".join(groups) if groups else ""

    def order(self, o: T.Order | None, _: str = "") -> str:
        return self.format(" order by {0.path:path}{0.desc:if desc}", o) if o else ""

    def given(self, v: object, word: str) -> str:
        """The word and what was given; a limit may be 0, other words say nothing then."""
        return "" if v is None or not v and word != "limit" else f" {word} {v if isinstance(v, str) else self.value(v)}"

    def steps(self, n: int | None, _: str = "") -> str:
        return "" if n == 1 else " upto " + ("any" if n is None else str(n))

    def budget(self, n: int, _: str = "") -> str:
        return "" if n == 2000 else f" budget {n} tokens"

    def prefer(self, source: str, _: str = "") -> str:
        return "" if source == "newest" else f" prefer source {source}"

    def _pairs(self, items: tuple, ends: str, show) -> str:
        return ends[0] + ", ".join(f"{k}: {show(v)}" for k, v in items) + ends[1]

    def values(self, items: tuple, _: str = "") -> str:
        return self._pairs(items, "{}", self.value)

    def kinds(self, items: tuple, _: str = "") -> str:
        return self._pairs(items, "{}", str)

    def columns(self, items: tuple, _: str = "") -> str:
        return self._pairs(items, "{}", lambda c: "col " + self.value(c))

    def roles(self, items: tuple, _: str = "") -> str:
        return self._pairs(items, "()", str)


# words that a template writes only where its field is true
setattr(_Spelling, "if", lambda self, v, word: f" {word}" if v else "")
_SPELLING = _Spelling()


def show(stmt: T.Stmt) -> str:
    return _SPELLING.vformat(_TEMPLATES[type(stmt)], (), {f.name: getattr(stmt, f.name) for f in fields(stmt)})


def canonical(program: str) -> str:
    return "\n".join(show(s) for s in parse(program))
