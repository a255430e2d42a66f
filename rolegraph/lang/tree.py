"""Syntax tree of a program: one dataclass per statement."""

from __future__ import annotations

from dataclasses import dataclass, field

Path = tuple[str, ...]


class _Absent:
    """The literal `none`."""

    def __repr__(self) -> str:
        return "none"


ABSENT = _Absent()


@dataclass(frozen=True)
class Clause:
    path: Path
    op: str
    value: object


#: A condition is an OR of ANDs.
Cond = tuple[tuple[Clause, ...], ...]


@dataclass(frozen=True)
class Order:
    path: Path
    desc: bool = False


@dataclass(frozen=True)
class Stmt:
    line: int = field(compare=False)


@dataclass(frozen=True)
class Find(Stmt):
    target: str
    name: str
    cond: Cond = ()
    order: Order | None = None


@dataclass(frozen=True)
class Follow(Stmt):
    source: str
    edge: str
    role: str
    name: str
    cond: Cond = ()
    upto: int | None = 1  # None: any number of steps
    optional: bool = False


@dataclass(frozen=True)
class Or(Stmt):
    pass


@dataclass(frozen=True)
class GroupBy(Stmt):
    path: Path
    name: str


@dataclass(frozen=True)
class Aggregate(Stmt):
    verb: str
    path: Path
    name: str
    distinct: bool = False


@dataclass(frozen=True)
class Keep(Stmt):
    name: str
    cond: Cond


@dataclass(frozen=True)
class Compute(Stmt):
    left: Path
    op: str
    right: Path
    name: str


@dataclass(frozen=True)
class Return(Stmt):
    cols: tuple[Path, ...]
    distinct: bool = False
    order: Order | None = None
    limit: int | None = None
    budget: int = 2000
    after: str | None = None


@dataclass(frozen=True)
class Continue(Stmt):
    handle: str
    budget: int = 2000


@dataclass(frozen=True)
class ShowSchema(Stmt):
    pass


@dataclass(frozen=True)
class AssertNode(Stmt):
    cls: str
    props: tuple[tuple[str, object], ...]
    name: str
    source: str | None = None


@dataclass(frozen=True)
class AssertEdge(Stmt):
    edge: str
    roles: tuple[tuple[str, str], ...]
    source: str | None = None


@dataclass(frozen=True)
class Merge(Stmt):
    a: str
    b: str
    prefer: str = "newest"  # or a provenance


@dataclass(frozen=True)
class Distinct(Stmt):
    a: str
    b: str
    reason: str


@dataclass(frozen=True)
class Refine(Stmt):
    ref: str
    cls: str
    mapping: tuple[tuple[str, str], ...]
    name: str


@dataclass(frozen=True)
class Compact(Stmt):
    source: str
    name: str
    props: tuple[tuple[str, object], ...]


@dataclass(frozen=True)
class Retire(Stmt):
    ref: str
    reason: str


@dataclass(frozen=True)
class Flag(Stmt):
    ref: str
    reason: str


@dataclass(frozen=True)
class DeriveClass(Stmt):
    name: str
    base: str
    props: tuple[tuple[str, str], ...]
    quota: int | None = None
    dedup: float | None = None


@dataclass(frozen=True)
class DeriveEdge(Stmt):
    name: str
    roles: tuple[tuple[str, str], ...]


BRANCH = (Find, Follow)
READS = (Find, Follow, Or, GroupBy, Aggregate, Keep, Compute, Return)
WRITES = (AssertNode, AssertEdge, Merge, Distinct, Refine, Compact, Retire, Flag, DeriveClass, DeriveEdge)


class ProgramError(Exception):
    """A program was refused before anything ran, or stopped while running."""


class SyntaxProblem(ProgramError):
    def __init__(self, line: int, message: str):
        super().__init__(f"line {line}: {message} (nothing was executed)")
        self.line = line
