"""The two doors: SPARQL text and structured queries."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.plans import algebra as A
from quadweave.plans.parser import parse_query
from quadweave.plans.translate import Rel, Translator
from quadweave.sources.datasets import Dataset, QuadDataset, Scope
from quadweave.terms import Val, n_triples

#: How a term becomes a plain column.
DECODE = {
    "str": lambda v: v.v,
    "int": lambda v: v.v.try_cast("bigint"),
    "double": lambda v: v.n,
    "dec": lambda v: v.n.cast("decimal(18,2)"),
    "ts": lambda v: v.t.cast("timestamp_ntz"),
    "bool": lambda v: v.v.isin("true", "1"),
    "term": n_triples,
}


@dataclass
class Engine:
    """Answers queries over a dataset. text and vectors are the retrieval tables that search patterns join with."""

    spark: SparkSession
    dataset: Dataset
    base: str = ""
    text: DataFrame | None = None
    vectors: DataFrame | None = None
    scope: Scope | None = None
    cache: dict = field(default_factory=dict)

    def _translator(self, scope: Scope | None) -> Translator:
        scope = scope or self.scope
        data = self.dataset.scoped(scope) if scope else self.dataset
        return Translator(data, self.spark, self.base, self.text, self.vectors)

    def solutions(self, query: str | A.Query, scope: Scope | None = None) -> Rel | DataFrame:
        q = parse_query(query, self.base) if isinstance(query, str) else query
        return self._translator(scope).query(q)

    def sparql(self, query: str | A.Query, types: dict[str, str] | None = None, scope: Scope | None = None) -> DataFrame:
        """SELECT: one column per variable, decoded as types says (default: N-Triples terms). ASK: one boolean. CONSTRUCT
        and DESCRIBE: triples (sk, s, p, ok, o, od, ol)."""
        out = self.solutions(query, scope)
        if isinstance(out, DataFrame):
            return out
        return out.df.select(*(DECODE[(types or {}).get(n, "term")](out.val(n)).alias(n) for n in out.vars))

    def ask(self, query: str, scope: Scope | None = None) -> bool:
        return bool(self.sparql(query, scope=scope).first()[0])

    def cached(self, query: str, types: dict[str, str] | None = None, scope: Scope | None = None, version: object = 0) -> DataFrame:
        """sparql() kept in Spark's cache under query, scope and the caller's data version; other versions are dropped."""
        key = (query, tuple(sorted((types or {}).items())), scope or self.scope)
        known = self.cache.get(key)
        if known and known[0] == version:
            return known[1]
        if known:
            known[1].unpersist()
        self.cache[key] = (version, self.sparql(query, types, scope).cache())
        return self.cache[key][1]

    def invalidate(self) -> int:
        for _, df in self.cache.values():
            df.unpersist()
        n = len(self.cache)
        self.cache.clear()
        return n

    def explain(self, query: str, scope: Scope | None = None) -> str:
        df = self.sparql(query, scope=scope)
        return df._jdf.queryExecution().toString()

    def query(self, spec: QuerySpec, types: dict[str, str] | None = None, scope: Scope | None = None) -> DataFrame:
        return self.sparql(spec.compiled(), types, scope)


@dataclass
class QuerySpec:
    """A structured query. Order of clauses: patterns and searches, values, binds, optional, unions, minus, exists, filters,
    late binds, group and having, order, projection, distinct, offset and limit."""

    select: list[str] | None = None
    patterns: list[A.Triple] = field(default_factory=list)
    graph: object = None
    searches: list = field(default_factory=list)
    values: list[A.Values] = field(default_factory=list)
    binds: list[A.Bind] = field(default_factory=list)
    optional: list[A.Group] = field(default_factory=list)
    unions: list[list[A.Group]] = field(default_factory=list)
    minus: list[A.Group] = field(default_factory=list)
    exists: list[A.Group] = field(default_factory=list)
    not_exists: list[A.Group] = field(default_factory=list)
    filters: list[A.Expr] = field(default_factory=list)
    late_binds: list[A.Bind] = field(default_factory=list)
    group_by: list[str] | None = None
    aggregates: dict[str, A.Expr] = field(default_factory=dict)
    having: list[A.Expr] = field(default_factory=list)
    order_by: list[tuple[str, bool]] = field(default_factory=list)
    distinct: bool = False
    limit: int | None = None
    offset: int = 0

    def compiled(self) -> A.Query:
        g = A.Group(list(self.searches))
        if self.patterns:
            bgp = A.BGP(list(self.patterns))
            g.elements.append(A.Graph(self.graph, A.Group([bgp])) if self.graph is not None else bgp)
        g.elements += [*self.values, *self.binds, *(A.Optional(o) for o in self.optional), *(A.Union(u) for u in self.unions), *(A.Minus(m) for m in self.minus)]
        g.filters = [*(A.Expr("exists", [e]) for e in self.exists), *(A.Expr("notexists", [e]) for e in self.not_exists), *self.filters]
        if self.late_binds:
            g = A.Group([g, *self.late_binds])
        projection = [(n, self.aggregates.get(n)) for n in self.select] if self.select is not None else None
        if self.aggregates and projection is None:
            projection = [(n, None) for n in self.group_by or []] + list(self.aggregates.items())
        group = [(A.Expr("var", name=n), n) for n in self.group_by] if self.group_by is not None else None
        order = [(A.Expr("var", name=n), d) for n, d in self.order_by]
        limit = None if self.limit is None else max(0, self.limit)
        return A.Query("select", A.Select(g, projection, self.distinct, group, self.having, order, limit, max(0, self.offset)))


def var(name: str) -> A.Expr:
    return A.Expr("var", name=name)


def value(term) -> A.Expr:
    return A.Expr("term", [term])


def test(op: str, *args: A.Expr) -> A.Expr:
    return A.Expr(op, list(args))


def call(name: str, *args: A.Expr) -> A.Expr:
    return A.Expr("call", list(args), name=name)


def aggregate(name: str, arg: A.Expr | None = None, distinct: bool = False) -> A.Expr:
    return A.Expr("agg", [] if arg is None else [arg], name, distinct)


def decoded(v: Val, kind: str) -> Column:
    return DECODE[kind](v)


def over_quads(spark: SparkSession, quads: DataFrame, **options) -> Engine:
    return Engine(spark, QuadDataset(quads=quads, **options))


__all__ = ["Engine", "F", "QuerySpec", "aggregate", "call", "over_quads", "test", "value", "var"]
