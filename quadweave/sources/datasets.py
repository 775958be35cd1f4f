"""Where patterns are matched: tables of quads, and relational tables seen as quads."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadweave.storage import group_of
from quadweave.terms import FIELDS, NUMERIC_IRIS, RDF, TYPE, TYPES, XSD, Blank, Iri, Literal, Val, Variable, constant, instant_of, make, null, number_of, same

#: Columns of a table of quads: graph IRI ('' is the default graph), subject, predicate, object, and source.
QUADS = "g string, sk string, s string, p string, ok string, o string, od string, ol string, source string, line int"


@dataclass(frozen=True)
class Scope:
    """What a query may read, applied at the scan: graphs and sources, allowed (None: all), denied, and by prefix.
    An empty allow-list allows nothing; facts without a source are never denied by source."""

    allowed_graphs: tuple[str, ...] | None = None
    denied_graphs: tuple[str, ...] = ()
    graph_prefix: str = ""
    allowed_sources: tuple[str, ...] | None = None
    denied_sources: tuple[str, ...] = ()
    denied_source_prefixes: tuple[str, ...] = ()
    source_prefix: str = ""

    def condition(self, g: Column, source: Column) -> Column:
        c = F.lit(True)
        if self.allowed_graphs is not None:
            c &= g.isin(list(self.allowed_graphs)) if self.allowed_graphs else F.lit(False)
        if self.denied_graphs:
            c &= ~g.isin(list(self.denied_graphs))
        if self.graph_prefix:
            c &= g.startswith(self.graph_prefix)
        if self.allowed_sources is not None:
            c &= F.coalesce(source.isin(list(self.allowed_sources)), F.lit(False)) if self.allowed_sources else F.lit(False)
        if self.source_prefix:
            c &= F.coalesce(source.startswith(self.source_prefix), F.lit(False))
        if self.denied_sources:
            c &= source.isNull() | ~source.isin(list(self.denied_sources))
        for p in self.denied_source_prefixes:
            c &= source.isNull() | ~source.startswith(p)
        return c

    def admits(self, g: str) -> bool:
        """Whether facts of graph g, whose source is g too, may be read."""
        return (
            (self.allowed_graphs is None or g in self.allowed_graphs) and g not in self.denied_graphs and g.startswith(self.graph_prefix)
            and (self.allowed_sources is None or g in self.allowed_sources) and g not in self.denied_sources
            and g.startswith(self.source_prefix) and not any(g.startswith(p) for p in self.denied_source_prefixes)
        )


@dataclass
class Matches:
    """Rows of a pattern or star: df has the columns of each variable; info: variable -> (template, static type)."""

    df: DataFrame
    info: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)


@dataclass(frozen=True)
class Dataset:
    """graphs: which graphs the default graph is (None: the real default graph; "union": all); named: those for GRAPH."""

    scope: Scope = Scope()
    graphs: tuple[str, ...] | str | None = None
    named: tuple[str, ...] | None = None

    def scoped(self, scope: Scope) -> Dataset:
        return replace(self, scope=scope)

    def with_graphs(self, default: list[str], named: list[str]) -> Dataset:
        """FROM and FROM NAMED; FROM NAMED alone leaves the default graph empty."""
        return replace(self, graphs=tuple(default), named=tuple(named)) if default or named else self


def literal_fields(v: Column, d: Column) -> dict[str, Column]:
    return {"n": number_of(v, d), "t": instant_of(v, d)}


@dataclass(frozen=True)
class QuadDataset(Dataset):
    """A DataFrame of QUADS; the same four terms count once, whatever their sources. unique: no four terms are in two rows, as
    in a stored layout, so that a scan needs no shuffle to find the same ones. bag: nor are the triples of different graphs
    the same."""

    quads: DataFrame = None
    unique: bool = False
    bag: bool = False

    def star(self, subject, pairs: list, graph) -> list[Matches]:
        return [self._match(subject, p, o, graph) for p, o in pairs]

    def visible(self, graph) -> DataFrame:
        q = self.quads.filter(self.scope.condition(F.col("g"), F.col("source")))
        if graph is None:
            if self.graphs == "union":
                return q
            return q.filter(F.col("g") == "") if self.graphs is None else q.filter(F.col("g").isin(list(self.graphs)) if self.graphs else F.lit(False))
        q = q.filter(F.col("g") != "")
        if self.named is not None:
            q = q.filter(F.col("g").isin(list(self.named)) if self.named else F.lit(False))
        return q.filter(F.col("g") == graph.value) if isinstance(graph, Iri) else q

    def _match(self, s, p, o, graph) -> Matches:
        df = self.visible(graph)
        obj = Val(F.col("ok"), F.col("o"), F.col("od"), F.col("ol"), **literal_fields(F.col("o"), F.col("od")))
        slots = [(s, make_of("sk", "s")), (p, make("iri", F.col("p"))), (o, obj)]
        if isinstance(graph, Variable):
            slots.append((graph, make("iri", F.col("g"))))
        keep: dict[str, Val] = {}
        for slot, v in slots:
            if isinstance(slot, Variable):
                if slot.name in keep:
                    df = df.filter(same(keep[slot.name], v))
                else:
                    keep[slot.name] = v
            elif isinstance(slot, frozenset):
                df = df.filter(v.v.isin([i.value for i in slot]))
            elif isinstance(slot, tuple):  # a negated set
                df = df.filter(~v.v.isin([i.value for i in slot]))
            else:
                df = df.filter(identical(v, slot))
        merged = graph is None and (self.graphs == "union" or len(self.graphs or ()) > 1)  # an RDF merge: a triple counts once
        if merged and not self.bag or not self.unique:
            df = df.dropDuplicates([*([] if merged else ["g"]), "sk", "s", "p", "ok", "o", "od", "ol"])
        columns = [c for n, v in keep.items() for c in v.columns(n)]
        return Matches(df.select(*columns) if columns else df.select(F.lit(1).alias("one")), dict.fromkeys(keep, (None, None)))


@dataclass(frozen=True)
class StoredDataset(QuadDataset):
    """Quads of a storage.Layout: a known predicate names the group of files that is read."""

    unique: bool = True

    def _match(self, s, p, o, graph) -> Matches:
        if not isinstance(p, Iri):
            return super()._match(s, p, o, graph)
        own = self.quads.filter(F.col("pg") == group_of(F.lit(p.value)))
        return QuadDataset._match(replace(self, quads=own), s, p, o, graph)


def make_of(k: str, v: str) -> Val:
    return Val(F.col(k), F.col(v), null("d"), null("l"), null("n"), null("t"))


def identical(v: Val, term) -> Column:
    """Identity with a constant, as simple comparisons that a scan can take."""
    kind = {Iri: "iri", Blank: "blank", Literal: "literal"}[type(term)]
    c = (v.k == kind) & (v.v == term.value)
    if isinstance(term, Literal):
        c &= v.d.isNull() if term.datatype is None else v.d == term.datatype
        c &= v.l.isNull() if term.lang is None else v.l == term.lang
    return c


@dataclass(frozen=True)
class Table:
    """A relational table seen as quads: subject urn:t:name/key; urn:c:name/column for values and urn:r:column for
    references; graph and source urn:g:name. Keys must be unique."""

    name: str
    key: tuple[str, ...]
    references: tuple[tuple[str, str], ...] = ()


# Keys and references of the relational tables that come with the engine's test data.
TABLES = [
    Table("region", ("r_regionkey",)),
    Table("nation", ("n_nationkey",), (("n_regionkey", "region"),)),
    Table("customer", ("c_custkey",), (("c_nationkey", "nation"),)),
    Table("supplier", ("s_suppkey",), (("s_nationkey", "nation"),)),
    Table("part", ("p_partkey",)),
    Table("orders", ("o_orderkey",), (("o_custkey", "customer"),)),
    Table("lineitem", ("l_orderkey", "l_linenumber"), (("l_orderkey", "orders"), ("l_partkey", "part"), ("l_suppkey", "supplier"))),
    Table("events", ("event_id",)),
    Table("documents", ("doc_id",)),
    Table("pages", ("page_id",)),
    Table("benchmark", ("item_id",)),
    Table("labels", ("doc_id",), (("doc_id", "documents"),)),
    Table("conversations", ("conv_id", "turn")),
]


@dataclass(frozen=True)
class RelationalDataset(Dataset):
    """Tables read in place. Patterns with one subject and one table's columns become a single scan of just these columns,
    without a join; comparisons on values reach the Parquet reader."""

    spark: SparkSession = None
    folder: str = ""
    tables: tuple[Table, ...] = tuple(TABLES)
    graphs: tuple[str, ...] | str | None = "union"

    def read(self, t: Table) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{t.name}.parquet")

    def visible(self, t: Table, graph) -> bool:
        g = f"urn:g:{t.name}"
        if not self.scope.admits(g):
            return False
        if graph is None:
            return self.graphs == "union" or self.graphs is not None and g in self.graphs
        return (self.named is None or g in self.named) and (not isinstance(graph, Iri) or graph.value == g)

    def subject(self, t: Table) -> Val:
        key = F.concat_ws("-", *(F.col(k).cast("string") for k in t.key)) if len(t.key) > 1 else F.col(t.key[0])
        prefix = f"urn:t:{t.name}/"
        out = make("iri", F.concat(F.lit(prefix), key.cast("string")))
        out.k = F.lit("iri")
        out.r, out.template = key, prefix
        return out

    def value(self, t: Table, column: str, kind: T.DataType) -> Val:
        c = F.col(column)
        if isinstance(kind, T.StringType):
            out = make(F.lit("literal"), c)
            out.static = "v"
            return out
        if isinstance(kind, T.TimestampType | T.TimestampNTZType):
            c = c.cast("timestamp")
            out = make(F.lit("literal"), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), XSD + "dateTime", None, None, c)
            out.static = "t"
            return out
        whole = isinstance(kind, T.IntegralType)
        out = make(F.lit("literal"), c.cast("string"), XSD + ("integer" if whole else "double"), None, c.cast("double"))
        out.static = "n"
        return out

    def reference(self, column: str, to: str) -> Val:
        prefix = f"urn:t:{to}/"
        out = make(F.lit("iri"), F.concat(F.lit(prefix), F.col(column).cast("string")))
        out.r, out.template = F.col(column), prefix
        return out

    def predicates(self, t: Table, df: DataFrame) -> dict[str, Val]:
        out = {f"urn:c:{t.name}/{f.name}": self.value(t, f.name, f.dataType) for f in df.schema.fields if isinstance(f.dataType, T.StringType | T.TimestampType | T.TimestampNTZType | T.NumericType)}
        own = {f"urn:r:{c}": self.reference(c, to) for c, to in t.references}
        kind = constant(Iri(f"urn:t:{t.name}"))
        return out | own | {TYPE: kind}

    def columns_of(self, p: str) -> list[Table]:
        if p.startswith("urn:c:"):
            return [t for t in self.tables if p.startswith(f"urn:c:{t.name}/")]
        if p.startswith("urn:r:"):
            return [t for t in self.tables if any(c == p[6:] for c, _ in t.references)]
        return list(self.tables)

    def star(self, subject, pairs: list, graph) -> list[Matches]:
        """Patterns that share a subject: one scan for those that a single table answers, others one by one."""
        groups: dict[str, list] = {}
        out = []
        for p, o in pairs:
            found = self.columns_of(p.value) if isinstance(p, Iri) else []
            if len(found) == 1:
                groups.setdefault(found[0].name, []).append((p, o))
            else:
                groups.setdefault("", []).append((p, o))
        types = [x for x in groups.get("", []) if x[0] == Iri(TYPE) and isinstance(x[1], Iri)]
        for x in types:  # a type pattern names the table
            name = x[1].value.removeprefix("urn:t:")
            if name in groups:
                groups[name].append(x)
                groups[""].remove(x)
        for t in self.tables:
            if groups.get(t.name):
                out.append(self._scan([t], subject, groups[t.name], graph))
        for x in groups.get("", []):
            p, o = x
            tables = self.columns_of(p.value) if isinstance(p, Iri) else list(self.tables)
            if p == Iri(TYPE) and isinstance(o, Iri):
                tables = [t for t in tables if o.value == f"urn:t:{t.name}"]
            out.append(self._scan(tables, subject, [x], graph))
        return out

    def _scan(self, tables: list[Table], subject, pairs: list, graph) -> Matches:
        parts = [m for t in tables if self.visible(t, graph) and (m := self._scan_one(t, subject, pairs, graph)) is not None]
        if not parts:
            names = {x.name for x in (subject, graph, *(y for pair in pairs for y in pair)) if isinstance(x, Variable)}
            schema = ", ".join(f"`{n}__{f}` {TYPES[f]}" for n in sorted(names) for f in FIELDS) or "one int"
            return Matches(self.spark.createDataFrame([], schema), dict.fromkeys(names, (None, None)))
        if len(parts) == 1:
            return parts[0]
        info = {n: (None, None) for n in parts[0].info}
        columns = [f"`{n}__{f}`" for n in info for f in FIELDS] or ["one"]
        return Matches(reduce(DataFrame.union, (p.df.select(*columns) for p in parts)), info)

    def _scan_one(self, t: Table, subject, pairs: list, graph) -> Matches | None:
        df = self.read(t)
        known = self.predicates(t, df)
        if any(isinstance(p, Variable | frozenset | tuple) for p, _ in pairs):
            return self._scan_any(t, df, known, subject, pairs[0], graph)
        keep: dict[str, Val] = {}

        def bind(slot, v: Val) -> bool:
            nonlocal df
            if isinstance(slot, Variable):
                if slot.name in keep:
                    a = keep[slot.name]
                    if a.template and v.template and a.template != v.template:
                        return False
                    df = df.filter(same(a, v))
                else:
                    keep[slot.name] = v
                    static = getattr(v, "static", None)
                    df = df.filter((v.r if v.template else v.n if static == "n" else v.t if static == "t" else v.v).isNotNull())
                return True
            if v.template:
                if not isinstance(slot, Iri) or not slot.value.startswith(v.template):
                    return False
                df = df.filter(v.r.cast("string") == slot.value[len(v.template) :])
                return True
            if getattr(v, "static", None) == "n":
                if not isinstance(slot, Literal) or slot.datatype not in NUMERIC_IRIS:
                    return False
                df = df.filter((v.n == float(slot.value)) & (v.v == slot.value) & (v.d == slot.datatype))
                return True
            df = df.filter(identical(v, slot))
            return True

        if not bind(subject, self.subject(t)):
            return None
        for p, o in pairs:
            v = known.get(p.value)
            if v is None or not bind(o, v):
                return None
        if isinstance(graph, Variable):
            bind(graph, constant(Iri(f"urn:g:{t.name}")))
        columns = [c for n, v in keep.items() for c in v.columns(n)]
        return Matches(df.select(*columns) if columns else df.select(F.lit(1).alias("one")), {n: (v.template, getattr(v, "static", None)) for n, v in keep.items()})

    def quads_of(self, t: Table, names: set[str] | None = None) -> DataFrame:
        """All of a table's quads, or those of some predicates: one scan, only the columns that are needed."""
        df = self.read(t)
        known = {p: v for p, v in self.predicates(t, df).items() if names is None or p in names}
        s = self.subject(t)
        items = [F.struct(F.lit(p).alias("p"), v.k.alias("ok"), v.v.alias("o"), v.d.alias("od")) for p, v in known.items()]
        rows = df.select(s.v.alias("s"), F.explode(F.array(*items)).alias("x")).filter("x.o is not null")
        g = F.lit(f"urn:g:{t.name}")
        return rows.select(g.alias("g"), F.lit("iri").alias("sk"), "s", "x.p", "x.ok", "x.o", "x.od", null("l").alias("ol"), g.alias("source"), F.lit(None).cast("int").alias("line"))

    def _scan_any(self, t: Table, df: DataFrame, known: dict[str, Val], subject, pair, graph) -> Matches:
        p, _ = pair
        names = None
        if isinstance(p, frozenset):
            names = {i.value for i in p} & set(known)
        elif isinstance(p, tuple):
            names = set(known) - {i.value for i in p}
        if names is not None and not names:
            return None
        return QuadDataset(quads=self.quads_of(t, names), graphs="union", unique=True, bag=True)._match(subject, pair[0], pair[1], graph)

    def quads(self, *names: str) -> DataFrame:
        """The tables' quads as a DataFrame of QUADS."""
        return reduce(DataFrame.union, (self.quads_of(t) for t in self.tables if not names or t.name in names))


def empty(spark: SparkSession) -> QuadDataset:
    return QuadDataset(quads=spark.createDataFrame([], QUADS))


__all__ = ["RDF", "Dataset", "Matches", "QuadDataset", "RelationalDataset", "Scope", "Table"]
