"""Running programs: as a lazy DataFrame, as values, or as text with writes."""

from __future__ import annotations

import secrets
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolegraph import render
from rolegraph.check import Node, Prior, verify
from rolegraph.lang import tree as T
from rolegraph.lang.parser import parse
from rolegraph.limits import guarded
from rolegraph.plans.compiler import Compiler, State


class RunProblem(T.ProgramError):
    """A program stopped while running; writes before the failing statement are kept."""


@dataclass
class _Rest:
    blocks: list[str]
    header: str | None
    shown: int
    total: int


@dataclass
class Session:
    """Programs over a graph: registered relations, or a store, which takes writes too."""

    graph: object
    bound: dict[str, tuple[str, list[str]]] = field(default_factory=dict)  # name -> (class, node ids) of earlier calls
    handles: dict[str, _Rest] = field(default_factory=dict)

    def _checked(self, program: str) -> list[T.Stmt]:
        stmts = parse(program)
        verify(stmts, self.graph.catalog, {k: c for k, (c, _) in self.bound.items()})
        return stmts

    @staticmethod
    def pipelines(stmts: list[T.Stmt]) -> list[list[T.Stmt]]:
        """Statements in runs that end with a return."""
        out: list[list[T.Stmt]] = [[]]
        for s in stmts:
            out[-1].append(s)
            if isinstance(s, T.Return):
                out.append([])
        return [p for p in out if p]

    def df(self, program: str) -> DataFrame:
        """The last return's rows as a lazy DataFrame; columns are named <binding>_<property>."""
        stmts = self._checked(program)
        if any(isinstance(s, T.WRITES) for s in stmts):
            raise T.ProgramError("df() and rows() read only; use run() or execute() for writes (nothing was executed)")
        last = [p for p in self.pipelines(stmts) if isinstance(p[-1], T.Return)]
        if not last:
            raise T.ProgramError("the program returns nothing (nothing was executed)")
        compiler = Compiler(self.graph)
        return compiler.returned(compiler.pipeline(last[-1]), last[-1][-1])

    def rows(self, program: str) -> list[list]:
        """The last return's rows as plain values."""
        df = self.df(program)
        out = guarded(self.graph.spark, df, lambda d: [list(r) for r in d.collect()])
        if getattr(self.graph, "track", False):
            for p in self.pipelines(self._checked(program)):
                self._track(p)
        return out

    def run(self, program: str) -> str:
        """Results and receipts as text; an error is text too."""
        try:
            return self.execute(program)
        except T.ProgramError as e:
            return f"error: {e}"

    def execute(self, program: str) -> str:
        """Results and receipts as text; raises ProgramError."""
        stmts = self._checked(program)
        out: list[str] = []
        pending: list[T.Stmt] = []
        writes = 0
        writer = None
        for s in stmts:
            try:
                if isinstance(s, T.ShowSchema):
                    out.append(self.graph.catalog.listing(self.graph.populated()))
                elif isinstance(s, T.Continue):
                    out.append(self._continue(s))
                elif isinstance(s, T.Return):
                    out.append(self._text(pending, s))
                    self._export(pending)
                    if getattr(self.graph, "track", False):
                        self._track(pending)
                    pending = []
                elif isinstance(s, T.WRITES):
                    if pending:
                        self._export(pending)
                        pending = []
                    if writer is None:
                        if not hasattr(self.graph, "commit"):
                            raise RunProblem(f"line {s.line}: this graph is read-only; open a store to write")
                        from rolegraph.store.writes import Writer

                        writer = Writer(self.graph, self.bound)
                    out.append(str(writer.write(s)))
                    writes += 1
                else:
                    pending.append(s)
            except RunProblem as e:
                raise RunProblem(f"{e}" + (f"; {writes} write{'s' * (writes != 1)} before it are kept" if writes else "")) from e
        if pending:
            self._export(pending)
        return "\n\n".join(out)

    def _state(self, stmts: list[T.Stmt]) -> tuple[Compiler, State]:
        compiler = Compiler(self.graph)
        return compiler, compiler.pipeline(stmts)

    def _export(self, stmts: list[T.Stmt]) -> None:
        """Keep what a pipeline has bound for references in writes."""
        names = [s.name for s in stmts if isinstance(s, (T.Find, T.Follow))]
        if not names or not hasattr(self.graph, "commit"):
            return
        _, state = self._state([s for s in stmts if isinstance(s, (*T.BRANCH, T.Or, T.Keep)) and not (isinstance(s, T.Keep) and s.name not in names)])
        for n in names:
            b = state.bound.get(n)
            if b is not None and b.kind == "node":
                ids = state.df.select(F.col(n).alias("n"), F.col(f"{n}__id").alias("id")).where("id is not null").distinct().orderBy("n")
                self.bound[n] = (b.cls, guarded(self.graph.spark, ids, lambda d: [r.id for r in d.collect()]))

    def _track(self, stmts: list[T.Stmt]) -> None:
        """Count what each follow walked through: where it came from and where it went."""
        walked = []
        for i, s in enumerate(stmts):
            if isinstance(s, T.Follow):
                _, state = self._state([x for x in stmts[: i + 1] if isinstance(x, (*T.BRANCH, T.Or))])
                ends = [F.struct(F.col(n).alias("nid"), F.col(f"{n}__state").alias("state")) for n in (s.source, s.name)]
                walked.append(state.df.where(F.col(s.name).isNotNull()).select(F.explode(F.array(*ends)).alias("e")).select("e.*"))
        self.graph.touch(walked)

    def _text(self, stmts: list[T.Stmt], s: T.Return) -> str:
        compiler, state = self._state([*stmts, s])
        blocks, header, total = render.blocks(self.graph, compiler, state, s)
        return self._emit(blocks, header, total, 0, s.budget)

    def _emit(self, blocks: list[str], header: str | None, total: int, before: int, budget: int) -> str:
        text, rest = render.emit(blocks, header, total, before, budget)
        if rest:
            handle = f"@c{secrets.token_hex(3)}"
            self.handles[handle] = _Rest(rest, header, before + len(blocks) - len(rest), total)
            text += f"\n{len(rest)} left out; for those: continue {handle}"
        return text

    def _continue(self, s: T.Continue) -> str:
        rest = self.handles.pop(s.handle, None)
        if rest is None:
            raise RunProblem(f"line {s.line}: the handle {s.handle} is unknown or used up")
        return self._emit(rest.blocks, rest.header, rest.total, rest.shown, s.budget)


__all__ = ["Node", "Prior", "RunProblem", "Session"]
