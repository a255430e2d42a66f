"""Lowering of a checked pipeline to one lazy DataFrame.

Every binding is a LONG column with the node's id and one column per property, `<name>__<property>`;
the optimizer prunes what nothing reads.  Rank columns (ids of seeds and walked edges, in order) give
rows the order in which they would be found, for ties, limits and representatives only.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolegraph.catalog import Catalog
from rolegraph.check import ANY, CANDIDATE, CLASS_ROW, HEALTH, PSEUDO
from rolegraph.functions.fold import folded
from rolegraph.functions.predicates import Resolved, condition
from rolegraph.lang import tree as T
from rolegraph.operators.health import ABSENT as SOUND
from rolegraph.operators.reach import reach, reach_counts, reach_self
from rolegraph.sources.relations import SPARK_TYPES

#: Rewrites that never change a result; tests switch them off.
REWRITES = {"semi": True, "anti": True, "once": True, "counted": True, "late": True}


@dataclass
class Bound:
    kind: str  # node | record | value
    cls: str = ""
    type: str = ""
    multi: bool = False
    counted: str = ""  # a node of which there is only this column, the number of those that a row would have


@dataclass
class Grouping:
    name: str
    path: T.Path
    members: dict[str, Bound]
    collapsed: bool = False


@dataclass
class State:
    df: DataFrame | None = None
    bound: dict[str, Bound] = field(default_factory=dict)
    rank: list[tuple[str, bool]] = field(default_factory=list)
    walked: dict[str, list[str]] = field(default_factory=dict)
    group: Grouping | None = None


def paths_of(stmt: T.Stmt) -> list[T.Path]:
    """Columns of bound names that a statement reads."""
    if isinstance(stmt, T.Return):
        return [*stmt.cols, *([stmt.order.path] if stmt.order else [])]
    if isinstance(stmt, (T.GroupBy, T.Aggregate)):
        return [stmt.path]
    if isinstance(stmt, T.Compute):
        return [stmt.left, stmt.right]
    if isinstance(stmt, T.Keep):
        return [(stmt.name,), *(c.path for g in stmt.cond for c in g), *((stmt.name, *c.path) for g in stmt.cond for c in g)]
    if isinstance(stmt, T.Follow):
        return [(stmt.source,)]
    return []


class Compiler:
    def __init__(self, graph, catalog: Catalog | None = None):
        self.graph = graph
        self.catalog = catalog or graph.catalog
        self.steps = 0

    # frames of nodes

    def frame(self, cls: str, health: bool = False) -> DataFrame:
        """nid, pseudo-properties and properties of a class and everything derived from it."""
        names = list(self.catalog.classes) if cls == ANY else self.catalog.family(cls)
        parts = [(c, df) for c in names if (df := self.graph.nodes(c)) is not None]
        if cls == ANY:
            kinds: dict[str, set[str]] = {}
            for c in names:
                for p, t in self.catalog.props(c).items():
                    kinds.setdefault(p, set()).add(t)
            props = {p: (k.copy().pop() if len(k) == 1 else "str") for p, k in kinds.items()}
        else:
            props = self.catalog.props(cls)
        multi = {p for p in props if any(self.catalog.is_multi(c, p) for c in names)}

        def column(df: DataFrame, p: str) -> Column:
            kind = f"array<{SPARK_TYPES[props[p]]}>" if p in multi else SPARK_TYPES[props[p]]
            return (F.col(p) if p in df.columns else F.lit(None)).cast(kind).alias(p)

        fixed = ["nid", "id", "class", "state", "query_traffic", "lineage"]
        frames = [df.select(*fixed, *(column(df, p) for p in props)) for _, df in parts]
        if not frames:
            schema = "nid long, id string, class string, state string, query_traffic long, lineage string" + "".join(f", `{p}` {f'array<{SPARK_TYPES[t]}>' if p in multi else SPARK_TYPES[t]}" for p, t in props.items())
            out = self.graph.spark.createDataFrame([], schema)
        else:
            out = reduce(DataFrame.union, frames)
        if health:
            h = self.graph.health().select(F.col("nid").alias("__h"), *(F.col(x).alias(f"__{x}") for x in HEALTH))
            out = out.join(h, out["nid"] == h["__h"], "left").select(*out.columns, *(F.coalesce(f"__{x}", F.lit(SOUND[x])).alias(f"health__{x}") for x in HEALTH))
        return out

    def prop(self, cls: str, rest: T.Path, prefix: str = "") -> Resolved:
        head = rest[0]
        if head == "health" and len(rest) == 2:
            return F.col(f"{prefix}health__{rest[1]}"), "float", False
        if head == "health":
            return F.concat_ws(", ", *(F.concat(F.lit(f"{x} "), F.round(F.col(f"{prefix}health__{x}"), 4).cast("string")) for x in HEALTH)), "str", False
        if cls == ANY:
            kinds = {self.catalog.props(c)[head] for c in self.catalog.classes if head in self.catalog.props(c)}
            if kinds:
                return F.col(prefix + head), kinds.pop() if len(kinds) == 1 else "str", any(self.catalog.is_multi(c, head) for c in self.catalog.classes)
            return F.col(prefix + head), PSEUDO[head], False
        props = self.catalog.props(cls)
        if head in props:
            return F.col(prefix + head), props[head], self.catalog.is_multi(cls, head)
        return F.col(prefix + head), PSEUDO[head], False

    def renamed(self, df: DataFrame, name: str) -> DataFrame:
        return df.select(*(F.col(c).alias(name if c == "nid" else f"{name}__{c}") for c in df.columns))

    # statements

    def pipeline(self, stmts: list[T.Stmt]) -> State:
        """Everything up to, not with, a return."""
        state, branches, i = State(), [], 0
        while i < len(stmts):
            s, rest = stmts[i], stmts[i + 1 :]
            if isinstance(s, T.Or):
                branches.append(state)
                state = State()
            else:
                if branches and not isinstance(s, T.BRANCH):
                    state, branches = self.union([*branches, state]), []
                if isinstance(s, T.Find):
                    state = self.find(state, s, rest)
                elif isinstance(s, T.Follow):
                    if self.is_anti(s, rest):
                        state = self.follow(state, s, rest, "left_anti")
                        i += 1
                    elif not branches and self.is_counted(state, s, rest):
                        state = self.follow(state, s, rest, "counted")
                    else:
                        state = self.follow(state, s, rest, "left" if s.optional else "left_semi" if self.is_semi(state, s, rest) else "inner")
                elif isinstance(s, T.GroupBy):
                    state.group = Grouping(s.name, s.path, dict(state.bound))
                elif isinstance(s, T.Aggregate):
                    if state.group is not None and s.path[0] == state.group.name:
                        self.collapse(state, [s, *rest])
                    elif s.name not in state.bound:
                        run = [s]
                        for r in rest:
                            if not isinstance(r, T.Aggregate):
                                break
                            run.append(r)
                        state = self.overall(state, run)
                elif isinstance(s, T.Keep):
                    if state.group is not None and s.name == state.group.name:
                        self.collapse(state, rest)
                    state.df = state.df.where(condition(s.cond, lambda p, s=s: self.keep_column(state, s, p)))
                elif isinstance(s, T.Compute):
                    self.compute(state, s)
            i += 1
        if branches:
            state = self.union([*branches, state])
        return state

    def wants_health(self, name: str, cond: T.Cond, order: T.Order | None, rest: list[T.Stmt]) -> bool:
        own = [c.path for g in cond for c in g] + ([order.path] if order else [])
        return any(p[0] == "health" for p in own) or any("health" in p[1:] and name in p for s in rest for p in paths_of(s))

    def find(self, state: State, s: T.Find, rest: list[T.Stmt]) -> State:
        if s.target in ("class", "dup_candidates"):
            df, fields = (self.class_rows(), CLASS_ROW) if s.target == "class" else (self.graph.candidates(), CANDIDATE)
            df = df.where(condition(s.cond, lambda p: (F.col(p[0]), fields[p[0]], False)))
            order = [(f"{s.name}__{s.order.path[0]}", s.order.desc)] if s.order else []
            df = df.select(*(F.col(c).alias(f"{s.name}__{c}") for c in fields))
            state = State(df if state.df is None else state.df.crossJoin(df), state.bound, state.rank, state.walked)
            state.bound[s.name] = Bound("record", s.target)
            state.rank = state.rank + order + [(f"{s.name}__{c}", False) for c in fields]
            return state
        health = self.wants_health(s.name, s.cond, s.order, rest)
        df = self.frame(s.target, health).where(condition(s.cond, lambda p: self.prop(s.target, p)))
        rank: list[tuple[str, bool]] = []
        if s.order:
            df = df.withColumn(f"__o{self.steps}", self.prop(s.target, s.order.path)[0])
        df = self.renamed(df, s.name)
        if s.order:
            df = df.withColumnRenamed(f"{s.name}____o{self.steps}", f"__o{self.steps}")
            rank.append((f"__o{self.steps}", s.order.desc))
        self.steps += 1
        rank.append((s.name, False))
        if state.df is None:
            return State(df, {s.name: Bound("node", s.target)}, rank, {})
        if s.name in state.bound:
            new = [c for c in df.columns if c not in state.df.columns]
            joined = state.df.join(df.select(F.col(s.name).alias("__same"), *new), F.col(s.name) == F.col("__same")).drop("__same")
        else:
            joined = state.df.crossJoin(df)
        state.bound.setdefault(s.name, Bound("node", s.target))
        return State(joined, state.bound, state.rank + rank, state.walked, state.group)

    def class_rows(self) -> DataFrame:
        rows = [(c.name, c.status, c.base, c.quota) for c in self.catalog.classes.values()]
        return self.graph.spark.createDataFrame(rows, "name string, status string, base string, quota long")

    @staticmethod
    def used(name: str, rest: list[T.Stmt]) -> bool:
        return any(name in p for s in rest for p in paths_of(s)) or any(isinstance(s, (T.Find, T.Follow)) and s.name == name for s in rest)

    def is_semi(self, state: State, s: T.Follow, rest: list[T.Stmt]) -> bool:
        """Whether only the existence of an arrival matters."""
        if not REWRITES["semi"] or s.optional or s.upto != 1 or s.name in state.bound or self.used(s.name, rest) or s.edge in state.walked:
            return False
        if any(isinstance(r, T.Follow) and r.edge == s.edge for r in rest):
            return False
        last = rest[-1] if rest else None
        numbers = [r for r in rest if isinstance(r, T.Aggregate)]
        return isinstance(last, T.Return) and all(r.distinct or r.verb in ("min", "max") for r in numbers) and not any(isinstance(r, T.Or) for r in rest)

    def is_anti(self, s: T.Follow, rest: list[T.Stmt]) -> bool:
        """`follow ... as y or none`, then `keep x where y = none`, and y isn't read again."""
        if not REWRITES["anti"] or not s.optional or s.upto != 1 or not rest or not isinstance(rest[0], T.Keep):
            return False
        return rest[0].cond == ((T.Clause((s.name,), "=", T.ABSENT),),) and rest[0].name != s.name and not self.used(s.name, rest[1:])

    def is_counted(self, state: State, s: T.Follow, rest: list[T.Stmt]) -> bool:
        """Whether only the number of distinct nodes reached from each source matters: it is grouped by the source, and rows aren't counted."""
        groups = [r for r in rest if isinstance(r, T.GroupBy)]
        if not REWRITES["counted"] or s.upto is not None or s.optional or s.name in state.bound or len(groups) != 1 or groups[0].path != (s.source,):
            return False
        numbers = [r for r in rest if isinstance(r, T.Aggregate)]
        own = [r for r in numbers if r.verb == "count" and r.distinct and r.path == (groups[0].name, s.name)]
        if not own or any(isinstance(r, T.Or) for r in rest) or self.used(s.name, [r for r in rest if all(r is not o for o in own)]):
            return False
        return all((r.distinct or r.verb in ("min", "max")) and r.path[0] == groups[0].name for r in numbers)

    def follow(self, state: State, s: T.Follow, rest: list[T.Stmt], how: str) -> State:
        edge = self.catalog.edges[s.edge]
        depart = edge.other(s.role)
        cls = edge.roles[s.role]
        k = self.steps
        self.steps += 1
        again = s.name in state.bound
        y = f"__y{k}" if again else s.name
        nodes = self.renamed(self.frame(cls, self.wants_health(s.name, s.cond, None, rest)), y)
        test = condition(s.cond, lambda p: (F.col(f"__via{k}__{p[1]}"), edge.props[p[1]], False) if p[0] == "via" else self.prop(cls, p, f"{y}__"))
        edges = self.graph.edges(s.edge)
        if how == "counted":
            right = reach_counts(state.df.select(s.source), edges, depart, s.role, nodes.where(test).select(y))
            df = state.df.join(right.select(F.col("src").alias(f"__d{k}"), F.col("n").alias(f"__n{k}")), F.col(s.source) == F.col(f"__d{k}")).drop(f"__d{k}")
            state.bound[s.name] = Bound("node", cls, counted=f"__n{k}")
            return State(df, state.bound, state.rank, state.walked, state.group)
        if s.upto == 1:
            right = edges.select(F.col("eid").alias(f"__e{k}"), F.col(depart).alias(f"__d{k}"), F.col(s.role).alias(f"__a{k}"), *(F.col(p).alias(f"__via{k}__{p}") for p in edge.props))
        else:
            sources = state.df.select(s.source)
            pairs = reach_self(sources, edges, depart, s.role) if s.upto is None and s.name == s.source else reach(sources, edges, depart, s.role, s.upto)
            right = pairs.select(F.col("src").alias(f"__d{k}"), F.col("node").alias(f"__a{k}"), F.col("node").alias(f"__e{k}"))
        right = right.join(nodes, F.col(f"__a{k}") == F.col(y)).where(test).drop(f"__a{k}", *(f"__via{k}__{p}" for p in edge.props))
        on = F.col(s.source) == F.col(f"__d{k}")
        if again:
            on = on & (F.col(s.name) == F.col(y))
        plain = s.upto == 1 and not s.optional
        if plain:
            for e in state.walked.get(s.edge, []):
                on = on & (F.col(e) != F.col(f"__e{k}"))
        df = state.df.join(right, on, how)
        if how in ("left_semi", "left_anti"):
            return State(df, state.bound, state.rank, state.walked, state.group)
        df = df.drop(f"__d{k}")
        if again:
            old = [c for c in df.columns if c.startswith(f"{y}__")]
            if s.optional:  # unmatched rows lose the binding
                df = df.withColumn(s.name, F.col(y)).withColumns({c: F.when(F.col(y).isNotNull(), F.col(c)) for c in df.columns if c.startswith(f"{s.name}__")})
            df = df.drop(y, *old)
        else:
            state.bound[s.name] = Bound("node", cls)
        if plain:
            state.walked[s.edge] = [*state.walked.get(s.edge, []), f"__e{k}"]
        return State(df, state.bound, [*state.rank, (f"__e{k}", False)], state.walked, state.group)

    def union(self, states: list[State]) -> State:
        shared = {n: b for n, b in states[-1].bound.items() if all(n in s.bound for s in states)}
        frames = []
        for i, s in enumerate(states):
            columns = [c for n in shared for c in s.df.columns if c == n or c.startswith(f"{n}__")]
            if any(d for _, d in s.rank):
                order = F.row_number().over(Window.orderBy(*self.sort_columns(s.rank)))  # an ordered branch has an order of its own
            else:
                order = F.array(*(F.coalesce(F.hash(c).cast("long") if dict(s.df.dtypes)[c] == "string" else F.col(c).cast("long"), F.lit(0)) for c, _ in s.rank))
            order = order if not any(d for _, d in s.rank) else F.array(order.cast("long"))
            frames.append(s.df.select(*columns, F.concat(F.array(F.lit(i).cast("long")), order).alias("__branch")))
        df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
        return State(df, shared, [("__branch", False)], {})

    # columns of bound names

    def column(self, state: State, path: T.Path) -> Resolved:
        head = path[0]
        g = state.group
        if g is not None and head == g.name:
            path = g.path if len(path) == 1 or path[1:] == ("key",) else path[1:]
            head = path[0]
        b = state.bound[head]
        if len(path) == 1:
            if b.kind == "value":
                return F.col(head), b.type, b.multi
            return F.col(head), "int", False
        if b.kind == "record":
            return F.col(f"{head}__{path[1]}"), (CLASS_ROW if b.cls == "class" else CANDIDATE)[path[1]], False
        return self.prop(b.cls, path[1:], f"{head}__")

    def keep_column(self, state: State, s: T.Keep, path: T.Path) -> Resolved:
        if path[0] in state.bound or (state.group is not None and path[0] == state.group.name):
            return self.column(state, path)
        return self.column(state, (s.name, *path))

    def compute(self, state: State, s: T.Compute) -> None:
        (a, ka, _), (b, kb, _) = self.column(state, s.left), self.column(state, s.right)
        missing = F.raise_error(F.lit(f"line {s.line}: compute {s.op} reads an absent value"))
        if s.op == "same":
            same = folded(a) == folded(b) if ka == kb == "str" else a == b if (ka == "str") == (kb == "str") else F.lit(False)
            value, kind = same, "bool"
        else:
            kind = "float" if s.op == "over" or "float" in (ka, kb) else "int"
            value = {"plus": a + b, "minus": a - b, "times": a * b, "over": a.cast("double") / F.when(b == 0, F.raise_error(F.lit(f"line {s.line}: division by zero"))).otherwise(b)}[s.op]
        state.df = state.df.withColumn(s.name, F.when(a.isNull() | b.isNull(), missing.cast(SPARK_TYPES[kind])).otherwise(value))
        state.bound[s.name] = Bound("value", type=kind)

    # aggregation

    def sort_columns(self, rank: list[tuple[str, bool]]) -> list[Column]:
        return [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last() for c, d in rank]

    def measure(self, state: State, verb: str, path: T.Path, distinct: bool) -> tuple[Column | None, str]:
        """An aggregate as a column, or None where it needs its own rows (sum and avg over distinct nodes)."""
        if state.bound[path[0]].counted:
            return F.max(state.bound[path[0]].counted), "int"
        col, kind, _ = self.column(state, path)
        root = F.col(path[0])
        node = state.bound[path[0]].kind == "node"
        if verb == "count":
            if not distinct:
                return F.count(col), "int"
            return F.count_distinct(F.when(col.isNotNull(), root) if node else col), "int"
        if verb in ("min", "max"):
            return (F.min if verb == "min" else F.max)(col), kind
        if distinct and node and len(path) > 1:
            return None, "float" if verb == "avg" else kind
        if verb == "sum":
            value = F.sum_distinct(col) if distinct else F.sum(col)
            return F.coalesce(value, F.lit(0).cast(SPARK_TYPES[kind])), kind
        return self._avg(col, distinct), "float"

    @staticmethod
    def _avg(col: Column, distinct: bool) -> Column:
        return F.sum_distinct(col).cast("double") / F.when(F.count_distinct(col) > 0, F.count_distinct(col)) if distinct else F.avg(col)

    def apart(self, state: State, keys: list[Column], a: T.Aggregate, path: T.Path) -> tuple[DataFrame, str]:
        """sum or avg of a property over distinct nodes: each node counts once, whatever its value."""
        col, kind, _ = self.column(state, path)
        once = state.df.groupBy(*keys, F.col(path[0]).alias("__node")).agg(F.any_value(col).alias("__x"))
        out = once.groupBy(*[f"__k{i}" for i in range(len(keys))]) if keys else once.groupBy()
        value = F.avg("__x") if a.verb == "avg" else F.coalesce(F.sum("__x"), F.lit(0).cast(SPARK_TYPES[kind]))
        return out.agg(value.alias(a.name)), "float" if a.verb == "avg" else kind

    def in_two_steps(self, state: State, a: T.Aggregate, path: T.Path, root: str) -> tuple[list[Column], Column, str] | None:
        """An aggregate over rows as one over rows of each node of `root` and then one over those nodes; None where it isn't one."""
        col, kind, _ = self.column(state, path)
        x, y = f"__x_{a.name}", f"__y_{a.name}"
        zero = F.lit(0).cast(SPARK_TYPES[kind]) if kind in SPARK_TYPES else F.lit(0)
        if a.verb in ("min", "max"):
            f = F.min if a.verb == "min" else F.max
            return [f(col).alias(x)], f(x), kind
        if a.distinct:
            if path[0] != root or state.bound[root].kind != "node":
                return None
            if a.verb == "count":
                return [F.max(col.isNotNull() & F.col(root).isNotNull()).alias(x)], F.count(F.when(F.col(x), 1)), "int"
            if len(path) == 1:
                return None
            return [F.any_value(col).alias(x)], F.avg(x) if a.verb == "avg" else F.coalesce(F.sum(x), zero), "float" if a.verb == "avg" else kind
        if a.verb == "count":
            return [F.count(col).alias(x)], F.coalesce(F.sum(x), F.lit(0)), "int"
        if a.verb == "sum":
            return [F.sum(col).alias(x)], F.coalesce(F.sum(x), zero), kind
        return [F.sum(col).alias(x), F.count(col).alias(y)], F.sum(x).cast("double") / F.when(F.sum(y) > 0, F.sum(y)), "float"

    def overall(self, state: State, run: list[T.Aggregate]) -> State:
        """Neighbouring aggregates over all rows: one row."""
        plain, frames, bound = [], [], {}
        for a in run:
            col, kind = self.measure(state, a.verb, a.path, a.distinct)
            if col is None:
                df, kind = self.apart(state, [], a, a.path)
                frames.append(df)
            else:
                plain.append(col.alias(a.name))
            bound[a.name] = Bound("value", type=kind)
        if plain:
            frames.insert(0, state.df.agg(*plain))
        df = reduce(DataFrame.crossJoin, frames)  # one row each
        return State(df.select(*bound), bound, [], {})

    def collapse(self, state: State, rest: list[T.Stmt]) -> None:
        """Rows become groups: all later aggregates of the group in one pass."""
        g = state.group
        if g.collapsed:
            return
        g.collapsed = True
        key_head = g.path[0]
        key_col, key_kind, key_multi = self.column(state, g.path)
        by_node = len(g.path) == 1 and state.bound[key_head].kind == "node"
        wanted = [s for s in rest if isinstance(s, T.Aggregate) and s.path[0] == g.name]
        keys = [key_col.alias("__k0")]
        plain, extra, made = [], [], {}
        roots = {a.path[1] for a in wanted if a.distinct and a.verb in ("sum", "avg") and len(a.path) > 2 and state.bound[a.path[1]].kind == "node"}
        steps = [self.in_two_steps(state, a, a.path[1:], next(iter(roots))) for a in wanted] if len(roots) == 1 and REWRITES["once"] else [None]
        once = next(iter(roots)) if all(x is not None for x in steps) else None  # the node that sums and averages count once
        for a in wanted if once is None else ():
            path = a.path[1:]
            col, kind = self.measure(state, a.verb, path, a.distinct)
            if col is None:
                df, kind = self.apart(state, keys, a, path)
                extra.append(df.withColumnRenamed("__k0", f"__j{len(extra)}"))
            else:
                plain.append(col.alias(a.name))
            made[a.name] = Bound("value", type=kind)
        rank = [c for c, _ in state.rank]
        order = F.struct(*rank) if rank else F.lit(0)
        carried = []
        for n, b in state.bound.items():
            for c in state.df.columns:
                if (c == n or c.startswith(f"{n}__")) and n not in made:
                    if by_node and n == key_head:
                        carried.append(F.any_value(c).alias(c))
                    else:
                        carried.append(F.min_by(c, order).alias(c))
        if once is None:
            df = state.df.groupBy(*keys).agg(*plain, F.min(order).alias("__first"), *carried)
        else:
            nodes = self.fetched(state, key_head) if by_node else None
            names = [c for n in state.bound for c in state.df.columns if (c == n or c.startswith(f"{n}__")) and n not in {a.name for a in wanted} and (nodes is None or n != key_head)]
            # dealt out by a number that isn't lowered: the tables of seen nodes stay small, and apart from those of the joins before
            dealt = state.df.repartition(int(self.graph.spark.conf.get("spark.sql.shuffle.partitions")), key_col, F.col(once))
            rows = dealt.groupBy(*keys, F.col(once).alias("__once")).agg(*(c for x, _, _ in steps for c in x), F.min(order).alias("__first"), *(F.min_by(c, order).alias(c) for c in names))
            df = rows.groupBy("__k0").agg(*(y.alias(a.name) for a, (_, y, _) in zip(wanted, steps)), F.min("__first").alias("__f"), *(F.min_by(c, "__first").alias(c) for c in names)).withColumnRenamed("__f", "__first")
            if nodes is not None:  # aggregates over whole numbers are hashed; with text they sort all rows
                df = df.join(nodes, F.col("__k0") == F.col(key_head), "left").drop(key_head).withColumn(key_head, F.col("__k0"))
            made = {a.name: Bound("value", type=k) for a, (_, _, k) in zip(wanted, steps)}
        for i, other in enumerate(extra):
            df = df.join(other, F.col("__k0").eqNullSafe(F.col(f"__j{i}")), "left").drop(f"__j{i}")
        if not by_node and len(g.path) > 1:
            df = df.withColumn(f"{key_head}__{'__'.join(g.path[1:])}", F.col("__k0"))
        state.df = df
        state.bound = {**state.bound, **made}
        state.rank = [("__first", False)]

    def fetched(self, state: State, name: str) -> DataFrame | None:
        """A bound node's columns by its id, each id once; None where the rows' columns may be from elsewhere."""
        own = [c for c in state.df.columns if c.startswith(f"{name}__")]
        if not REWRITES["late"] or any(c == "__branch" for c, _ in state.rank):
            return None
        nodes = self.renamed(self.frame(state.bound[name].cls, any(c.startswith(f"{name}__health__") for c in own)), name)
        if not set(own) <= set(nodes.columns):
            return None
        return nodes.groupBy(name).agg(*(F.any_value(c).alias(c) for c in own))

    # return

    def shown(self, state: State, path: T.Path) -> Column:
        """A returned column's value; a bare node is its name, title or id."""
        head = path[0]
        if state.group is not None and head == state.group.name:
            path = state.group.path if len(path) == 1 or path[1:] == ("key",) else path[1:]
        b = state.bound[path[0]]
        if len(path) == 1 and b.kind == "node":
            names = [f"{path[0]}__{p}" for p in ("name", "title", "id") if f"{path[0]}__{p}" in state.df.columns]
            return F.when(F.col(path[0]).isNotNull(), F.coalesce(*(F.col(c).cast("string") for c in names)))
        return self.column(state, path)[0]

    def keys(self, state: State, path: T.Path) -> Column:
        """What a returned column is told apart by: a node's id, or else the value."""
        grouped = state.group is not None and path[0] == state.group.name
        if grouped:
            by_key = len(path) == 1 or path[1:] == ("key",)
            path = state.group.path if by_key else path[1:]
            if by_key and len(path) > 1:
                return self.column(state, path)[0]
        if state.bound[path[0]].kind == "node":
            return F.col(path[0])
        return self.column(state, path)[0]

    def returned(self, state: State, s: T.Return, with_ids: bool = False) -> DataFrame:
        if state.group is not None and not state.group.collapsed and any(p[0] == state.group.name and (len(p) == 1 or p[1:] == ("key",)) for p in (*s.cols, *([s.order.path] if s.order else []))):
            self.collapse(state, [])
        names: list[str] = []
        for p in s.cols:
            n = "_".join(p)
            while n in names:
                n += "_"
            names.append(n)
        out = [self.shown(state, p).alias(f"__c{i}") for i, p in enumerate(s.cols)]
        ids = [self.keys(state, p).alias(f"__i{i}") for i, p in enumerate(s.cols)]
        told = [f"__c{i}" for i in range(len(out))] if s.distinct else [f"__i{i}" for i in range(len(out))]
        ordered = s.order is not None or s.limit is not None or with_ids
        df = state.df
        if not ordered:
            df = df.select(*out, *([] if s.distinct else ids)).distinct()
        else:
            rank = [c for c, _ in state.rank]
            key = [self.column(state, s.order.path)[0] if not self._bare(state, s.order.path) else self.shown(state, s.order.path)] if s.order else []
            df = df.select(*out, *ids, *(c.alias("__order") for c in key), *rank)
            first = F.row_number().over(Window.partitionBy(*told).orderBy(*self.sort_columns(state.rank) or [F.lit(1)]))
            if any(d for _, d in state.rank) or not self._depends(state, s):
                df = df.withColumn("__n", first).where("__n = 1").drop("__n")
                sort = self.sort_columns(state.rank)
            else:
                carried = [f"__c{i}" for i in range(len(out))] + (["__order"] if s.order else []) + [f"__i{i}" for i in range(len(out))]
                df = df.groupBy(*[c for c in dict.fromkeys(carried)]).agg(F.min(F.struct(*rank) if rank else F.lit(0)).alias("__first"))
                sort = [F.col("__first")]
            if s.order:
                sort = [F.col("__order").desc_nulls_last() if s.order.desc else F.col("__order").asc_nulls_last(), *sort]
            df = df.orderBy(*sort) if sort else df
            if s.limit is not None and not with_ids:
                df = df.limit(s.limit)
        shown = [F.col(f"__c{i}").alias(n) for i, n in enumerate(names)]
        return df.select(*shown, *([F.col(f"__i{i}") for i in range(len(out))] if with_ids else []))

    def _bare(self, state: State, path: T.Path) -> bool:
        return len(path) == 1 and path[0] in state.bound and state.bound[path[0]].kind == "node"

    def _depends(self, state: State, s: T.Return) -> bool:
        """Whether the order's column is fixed by what tells rows apart."""
        if s.order is None:
            return not s.distinct
        return not s.distinct and any(p == s.order.path or (p[0] == s.order.path[0] and p[0] in state.bound and state.bound[p[0]].kind == "node") for p in s.cols)
