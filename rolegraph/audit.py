"""Proofs about programs and results: results compared, recorded results replayed, broken programs refused."""

from __future__ import annotations

import json
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, fields, is_dataclass, replace

from rolegraph.check import verify
from rolegraph.lang import tree as T
from rolegraph.lang.canonical import show
from rolegraph.lang.parser import parse
from rolegraph.session import Session

#: A name that no schema has.
_STRANGE = "zz_no_such_name"


def _plain(v: object, digits: int) -> object:
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        x = float(v)
        return x if not math.isfinite(x) or not x else round(x, digits - 1 - math.floor(math.log10(abs(x))))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x, digits) for x in v)
    return str(v)


def same_rows(got: list, want: list, ordered: bool = False, digits: int = 9) -> bool:
    """Whether two results hold the same rows, each as often; numbers agree to so many significant digits."""
    a, b = ([_plain(list(r), digits) for r in rows] for rows in (got, want))
    return a == b if ordered else Counter(a) == Counter(b)


def is_ordered(program: str) -> bool:
    """Whether the program's last return fixes the order of rows."""
    last = [s for s in parse(program) if isinstance(s, T.Return)]
    return bool(last) and last[-1].order is not None


@dataclass
class Report:
    right: int = 0
    wrong: list[str] = field(default_factory=list)
    failed: list[tuple[str, str]] = field(default_factory=list)


def record(session: Session, programs: list[str], path: str) -> None:
    """Write the programs with the rows they give now, a JSON line each."""
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(json.dumps({"program": p, "rows": session.rows(p)}, ensure_ascii=False, default=str) + "\n" for p in programs)


def replay(session: Session, path: str) -> Report:
    """Run recorded programs again and hold the rows against those of the file."""
    out = Report()
    with open(path, encoding="utf-8") as f:
        for line in filter(str.strip, f):
            was = json.loads(line)
            try:
                got = json.loads(json.dumps(session.rows(was["program"]), default=str))
            except T.ProgramError as e:
                out.failed.append((was["program"], str(e)))
                continue
            if same_rows(got, was["rows"], is_ordered(was["program"])):
                out.right += 1
            else:
                out.wrong.append(was["program"])
    return out


def _breaks(s: T.Stmt) -> Iterator[tuple[str, T.Stmt]]:
    """The statement with one name that means nothing, for each place that holds a name."""
    strange = lambda path: (*path[:-1], _STRANGE) if len(path) > 1 else (_STRANGE,)
    known = {T.Find: ("target",), T.Follow: ("source", "edge", "role"), T.Keep: ("name",), T.AssertNode: ("cls",), T.AssertEdge: ("edge",), T.Compact: ("source",), T.DeriveClass: ("base",)}
    for name in known.get(type(s), ()):
        yield f"unknown {name}", replace(s, **{name: _STRANGE})
    for f in fields(s):
        value = getattr(s, f.name)
        if f.name in ("path", "left", "right"):
            yield f"unknown {f.name}", replace(s, **{f.name: strange(value)})
        elif f.name == "cols":
            yield "unknown column", replace(s, cols=(*value[:-1], strange(value[-1])))
        elif f.name == "cond" and value:
            first, *more = value[0]
            yield "unknown condition", replace(s, cond=((replace(first, path=strange(first.path)), *more), *value[1:]))
        elif f.name == "props" and value and isinstance(s, T.AssertNode):
            yield "unknown property", replace(s, props=((_STRANGE, value[0][1]), *value[1:]))
        elif f.name == "roles" and value:
            yield "unknown role", replace(s, roles=((_STRANGE, value[0][1]), *value[1:]))


def mutants(program: str) -> Iterator[tuple[str, str]]:
    """(what was broken, program): the program with one thing broken, in all ways known here."""
    stmts = parse(program)
    for i, s in enumerate(stmts):
        assert is_dataclass(s)
        for what, broken in _breaks(s):
            yield f"line {i + 1}: {what}", "\n".join(map(show, [*stmts[:i], broken, *stmts[i + 1 :]]))
    for i, s in enumerate(stmts):  # a binding that later lines read goes
        if isinstance(s, (T.Find, T.Follow)) and i + 1 < len(stmts) and not any(isinstance(x, (T.Find, T.Follow)) and x.name == s.name for x in stmts[:i] + stmts[i + 1 :]):
            yield f"line {i + 1}: left out", "\n".join(map(show, stmts[:i] + stmts[i + 1 :]))


def audit(programs: list[str], catalog) -> tuple[int, list[tuple[str, str]]]:
    """How many broken programs the checker refuses, and those that it lets through, with what was broken."""
    refused, silent = 0, []
    for program in programs:
        verify(parse(program), catalog)  # sound as it is
        for what, broken in mutants(program):
            try:
                verify(parse(broken), catalog)
                silent.append((what, broken))
            except T.ProgramError:
                refused += 1
    return refused, silent
