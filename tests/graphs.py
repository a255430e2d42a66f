"""Small graphs for tests, and a plain interpreter of read programs over them: rows as dictionaries, no Spark."""

from __future__ import annotations

from rolegraph.catalog import Catalog
from rolegraph.functions.fold import fold
from rolegraph.lang import tree as T
from rolegraph.lang.parser import parse
from rolegraph.sources.relations import Relations

ORCHESTRAS = [(1, "Harmonia", "PL", 1901), (2, "Łódź Brass", "PL", 1950), (3, "Nordlys", "NO", None), (4, "Harmonia", "FI", 1988), (5, "Über Klang", "DE", 2001)]
PLAYERS = [(1, "Ines", 34.5, ["oboe", "flute"]), (2, "José", 51.0, ["horn"]), (3, "jose", 20.0, []), (4, "Mirja", None, None), (5, "Ove", 44.0, ["flute"]), (6, "Zoë", 28.0, ["harp", "oboe"])]
SEATS = [(1, 1, 1, 1999, None), (2, 1, 2, 2003, 2010), (3, 2, 2, 2011, None), (4, 3, 4, 1990, 1995), (5, 5, 4, 1996, None), (6, 1, 5, 2005, 2006), (7, 6, 1, 2015, None), (8, 2, 1, 2000, 2001)]
MENTORS = [(1, 1, 2), (2, 2, 3), (3, 3, 1), (4, 3, 5), (5, 5, 6), (6, 4, 4)]


def relations(spark) -> Relations:
    g = Relations(spark)
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    g.add_class("orchestra", frame(ORCHESTRAS, "k long, name string, country string, founded int"), "k")
    g.add_class("player", frame([p for p in PLAYERS if p[0] <= 4], "k long, name string, age double, plays array<string>"), "k")
    g.add_class("soloist", frame([p for p in PLAYERS if p[0] > 4], "k long, name string, age double, plays array<string>"), "k", base="player")
    seats = frame(SEATS, "e long, p long, o long, start int, stop int")
    g.add_edge("seat", seats, {"who": ("player", "p"), "place": ("orchestra", "o")}, {"start": "start", "stop": "stop"}, unique=True)
    g.add_edge("mentors", frame(MENTORS, "e long, a long, b long"), {"senior": ("player", "a"), "junior": ("player", "b")}, unique=True)
    return g


class Plain:
    """What a program means, row by row."""

    def __init__(self):
        self.nodes = {("orchestra", k): {"class": "orchestra", "name": n, "country": c, "founded": f} for k, n, c, f in ORCHESTRAS}
        self.nodes |= {("player", k): {"class": "player" if k <= 4 else "soloist", "name": n, "age": a, "plays": p} for k, n, a, p in PLAYERS}
        self.edges = {
            "seat": [(i, {"who": ("player", p), "place": ("orchestra", o)}, {"start": s, "stop": t}) for i, p, o, s, t in SEATS],
            "mentors": [(i, {"senior": ("player", a), "junior": ("player", b)}, {}) for i, a, b in MENTORS],
        }

    @staticmethod
    def holds(value, op, want) -> bool:
        absent = value is None or value == []
        if want is T.ABSENT:
            return absent if op == "=" else not absent
        if value is None:
            return False
        if isinstance(value, list):
            if op in ("=", "contains"):
                return any(Plain.holds(v, op, want) for v in value)
            return op == "!=" and not any(Plain.holds(v, "=", want) for v in value)
        if op == "contains":
            return fold(str(want)) in fold(str(value))
        if isinstance(value, str) != isinstance(want, str):
            return op == "!="
        if isinstance(value, str):
            value, want = fold(value), fold(want)
        return {"=": value == want, "!=": value != want, "<": value < want, "<=": value <= want, ">": value > want, ">=": value >= want}[op]

    def test(self, cond, read) -> bool:
        return not cond or any(all(self.holds(read(c.path), c.op, c.value) for c in g) for g in cond)

    def read(self, row, path):
        value = row.get(path[0])
        return value if len(path) == 1 or value is None else self.nodes[value].get(path[1])

    def run(self, program: str) -> list[tuple]:
        rows, group, branches = [{}], None, []
        for s in parse(program):
            if isinstance(s, T.Or):
                branches.append(rows)
                rows = [{}]
                continue
            if branches and not isinstance(s, T.BRANCH):
                rows, branches = [r for b in [*branches, rows] for r in b], []
            if isinstance(s, T.Find):
                rows = [{**r, s.name: n} for r in rows for n, v in self.nodes.items() if s.target in (v["class"], n[0]) and self.test(s.cond, lambda p, v=v: v.get(p[0])) and r.get(s.name, n) == n]
            elif isinstance(s, T.Follow):
                rows = self.follow(rows, s)
            elif isinstance(s, T.GroupBy):
                group = (s.name, s.path)
            elif isinstance(s, T.Aggregate):
                rows = self.aggregate(rows, s, group)
            elif isinstance(s, T.Keep):
                rows = [r for r in rows if self.test(s.cond, lambda p, r=r: self.read(r, p) if p[0] in r else self.read(r, (s.name, *p)))]
            elif isinstance(s, T.Return):
                seen = {}
                for r in rows:
                    out = tuple(self.shown(r, p, group) for p in s.cols)
                    key = out if s.distinct else tuple(self.key(r, p, group) for p in s.cols)
                    seen.setdefault(repr(key), out)
                return sorted(seen.values(), key=repr)
        raise AssertionError

    def key(self, r, p, group):
        """A node tells rows apart by itself, anything else by its value."""
        if group and p[0] == group[0]:
            by_key = len(p) == 1 or p[1] == "key"
            p = group[1] if by_key else p[1:]
            if by_key and len(p) > 1:
                return self.read(r, p)
        return r.get(p[0])

    def shown(self, r, p, group):
        if group and p[0] == group[0]:
            p = group[1] if len(p) == 1 or p[1] == "key" else p[1:]
        v = self.read(r, p)
        return self.nodes[v]["name"] if isinstance(v, tuple) else v

    def follow(self, rows, s):
        out = []
        for r in rows:
            if s.upto != 1:
                seen, front, depth = [], [r[s.source]], 0
                while front and (s.upto is None or depth < s.upto):
                    front = [n for n in dict.fromkeys(e[s.role] for _, e, _ in self.edges[s.edge] if any(v in front for k, v in e.items() if k != s.role)) if n not in seen]
                    seen += front
                    depth += 1
                found = [(None, n) for n in seen if self.test(s.cond, lambda p, n=n: self.nodes[n].get(p[0])) and (s.name not in r or r[s.name] == n)]
            else:
                found = []
                for i, ends, props in self.edges[s.edge]:
                    other = next(k for k in ends if k != s.role)
                    n = ends[s.role]
                    if ends[other] != r[s.source] or (not s.optional and (s.edge, i) in r.get("__trail", ())) or (s.name in r and r[s.name] != n):
                        continue
                    if self.test(s.cond, lambda p, n=n, props=props: props.get(p[1]) if p[0] == "via" else self.nodes[n].get(p[0])):
                        found.append((i, n))
            if s.optional and not found:
                found = [(None, None)]
            for i, n in found:
                trail = r.get("__trail", ())
                out.append({**r, s.name: n, "__trail": trail if i is None or s.optional else (*trail, (s.edge, i))})
        return out

    def aggregate(self, rows, s, group):
        def value(members, path):
            if s.distinct:
                members = list({repr(m.get(path[0])): m for m in members}.values())
            values = [v for m in members if (v := self.read(m, path)) is not None]
            if s.verb == "count":
                return len(values)
            if s.verb == "sum":
                return sum(values)
            if not values:
                return None
            return {"avg": lambda: sum(values) / len(values), "min": lambda: min(values), "max": lambda: max(values)}[s.verb]()

        if group is None or s.path[0] != group[0]:
            return [{s.name: value(rows, s.path)}]
        if rows and "__members" not in rows[0]:
            made = {}
            for r in rows:
                made.setdefault(repr(self.read(r, group[1])), []).append(r)
            rows = [{**m[0], "__members": m} for m in made.values()]
        return [{**r, s.name: value(r["__members"], s.path[1:])} for r in rows]
