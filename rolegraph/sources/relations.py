"""A graph over existing DataFrames: classes and edge types are registered, nothing is loaded or copied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from rolegraph.catalog import Catalog

SPARK_TYPES = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean"}
_TYPES = {"string": "str", "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int", "float": "float", "double": "float", "boolean": "bool"}
NODE_COLUMNS = ("nid", "id", "class", "state", "query_traffic", "lineage")


class Relations:
    """Classes with a whole-number or string key each; a derived class shares its base's key space.

    Node ids are LONG: a class family's ordinal in the upper bits with a whole-number key below, or a
    64-bit hash of the family and a string key.  Whole-number keys that need more than KEY_BITS or are
    negative get a negative hash, so they never run into another family's ids.
    """

    KEY_BITS = 48

    def __init__(self, spark: SparkSession, catalog: Catalog | None = None):
        self.spark = spark
        self.catalog = catalog or Catalog.standard()
        self._nodes: dict[str, DataFrame] = {}
        self._edges: dict[str, DataFrame] = {}
        self._roots: dict[str, int] = {}

    def _root(self, cls: str) -> int:
        root = self.catalog.lineage(cls)[-1]
        return self._roots.setdefault(root, len(self._roots) + 1)

    def nid(self, cls: str, key: Column, kind: str) -> Column:
        if kind == "string":
            return F.xxhash64(F.lit(self._root(cls)), key)
        whole, root = key.cast("long"), F.lit(self._root(cls) << self.KEY_BITS).cast("long")
        plain = root + whole
        if kind in ("tinyint", "smallint"):  # narrow keys can only be negative
            return F.when(whole >= 0, plain).otherwise(F.xxhash64(root, whole).bitwiseOR(F.lit(-1 << 63)))
        return F.when((whole >= 0) & (whole < 1 << self.KEY_BITS), plain).otherwise(F.xxhash64(root, whole).bitwiseOR(F.lit(-1 << 63)))

    def add_class(self, name: str, df: DataFrame, key: str, props: dict[str, Column | str] | None = None, base: str | None = None) -> None:
        """Register df's rows as nodes; props maps property names to columns (all but the key, if not given)."""
        columns = {p: F.col(c) if isinstance(c, str) else c for p, c in (props or {c: c for c in df.columns if c != key}).items()}
        kinds = dict(df.select(*[c.alias(p) for p, c in columns.items()]).dtypes) if columns else {}
        declared, multi, shown = {}, set(), []
        for p, c in columns.items():
            kind = kinds[p]
            if kind.startswith("array<"):
                multi.add(p)
                kind = kind[6:-1]
            if kind not in _TYPES:  # dates and others are kept as text
                c, kind = c.cast("string"), "string"
            declared[p] = _TYPES[kind]
            shown.append((c if p in multi else c.cast(SPARK_TYPES[_TYPES[kind]])).alias(p))
        inherited = self.catalog.props(base) if base else {}
        if name not in self.catalog.classes:
            self.catalog.add_class(name, {p: t for p, t in declared.items() if inherited.get(p) != t}, base, multi=frozenset(multi))
        kind = dict(df.dtypes)[key]
        label = F.concat(F.lit(f"#{name[0]}-"), F.col(key).cast("string"))
        self._nodes[name] = df.where(F.col(key).isNotNull()).select(
            self.nid(name, F.col(key), kind).alias("nid"), label.alias("id"), F.lit(name).alias("class"), F.lit("atom").alias("state"), F.lit(0).cast("long").alias("query_traffic"), F.lit("").alias("lineage"), *shown
        )

    def add_edge(self, name: str, df: DataFrame, roles: dict[str, tuple[str, str]], props: dict[str, Column | str] | None = None, unique: bool = False) -> None:
        """Register df's rows as edges; roles maps role names to (class, key column).

        An edge's id comes from its place in the file it was read from, or, where `unique` says that
        the endpoints and properties make it one, from those.
        """
        columns = {p: F.col(c) if isinstance(c, str) else c for p, c in (props or {}).items()}
        kinds = dict(df.select(*[c.alias(p) for p, c in columns.items()]).dtypes) if columns else {}
        shown = []
        declared = {}
        for p, c in columns.items():
            declared[p] = _TYPES.get(kinds[p], "str")
            shown.append(c.cast(SPARK_TYPES[declared[p]]).alias(p))
        if name not in self.catalog.edges:
            self.catalog.add_edge(name, {r: c for r, (c, _) in roles.items()}, declared)
        types = dict(df.dtypes)
        ends = [self.nid(c, F.col(k), types[k]).alias(r) for r, (c, k) in roles.items()]
        keys = [F.col(k) for _, k in roles.values()]
        if unique:
            eid = F.xxhash64(*keys, *columns.values())
        else:
            try:
                eid = F.xxhash64("_metadata.file_path", "_metadata.row_index")
                df.select(eid)
            except AnalysisException:
                eid = F.monotonically_increasing_id()
        whole = keys[0].isNotNull() & keys[1].isNotNull()
        self._edges[name] = df.where(whole).select(eid.alias("eid"), *ends, *shown)

    # what the compiler asks of a graph

    def nodes(self, cls: str) -> DataFrame | None:
        return self._nodes.get(cls)

    def edges(self, name: str) -> DataFrame:
        df = self._edges.get(name)
        if df is None:
            e = self.catalog.edges[name]
            return self.spark.createDataFrame([], "eid long, " + ", ".join(f"`{r}` long" for r in e.roles) + "".join(f", `{p}` {SPARK_TYPES[t]}" for p, t in e.props.items()))
        return df

    def populated(self) -> set[str]:
        return {c for c, df in self._nodes.items() if not df.isEmpty()}

    def position(self) -> int:
        return 0

    def health(self) -> DataFrame:
        from rolegraph.operators.health import health

        return health(self)

    def signals(self) -> DataFrame:
        """(nid, conflicts, flags, traversals, last_confirmed): nothing is known of registered rows."""
        return self.spark.createDataFrame([], "nid long, conflicts long, flags long, traversals long, last_confirmed long")

    def candidates(self) -> DataFrame:
        from rolegraph.operators.duplicates import sweep

        return sweep(self)
