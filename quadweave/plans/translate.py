"""From algebra to DataFrames. What Catalyst cannot know is decided here: the order of a basic graph pattern, join keys of
variables that may be unbound, scopes of nested filters, and the iteration of transitive paths."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import combinations
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.errors import UnsupportedQuery
from quadweave.functions.expressions import compile_expr, condition
from quadweave.operators import paths
from quadweave.plans.algebra import BGP, Bind, Expr, Graph, Group, Minus, Optional, Path, PathSearch, Query, Select, TextSearch, Triple, Union, Values, VectorSearch, variables
from quadweave.sources.datasets import Dataset
from quadweave.terms import FIELDS, INTEGER_IRIS, TYPES, XSD, Blank, Iri, Val, Variable, constant, digits, from_columns, identity, make, n_triples, null, number, order_keys, same, string


#: Shared variables that may be unbound, on either side, up to which an inner join is split by which of them are.
SPLITS = 3
#: Times that what is searched must be larger than the sources that are bound, for these to be looked up first.
FEW = 4
#: Predicates by which SPARQL text asks for a search, all with one blank node as subject: text, vector or from say what is
#: looked for, options of the search take constants, and other names bind columns of its hits to variables.
SEARCH = "urn:search:"
# Names of the options and what each becomes.
OPTIONS = {"limit": "limit", "offset": "offset", "perSource": "per_source", "sourcePrefix": "source_prefix", "metric": "metric", "threshold": "threshold", "depth": "depth", "direction": "direction", "to": "target"}


@dataclass
class Info:
    """What is known of a variable: bound in every row, the template of its IRIs, its only kind of value."""

    certain: bool = True
    template: str | None = None
    static: str | None = None


@dataclass
class Rel:
    df: DataFrame
    vars: dict[str, Info] = field(default_factory=dict)
    masks: list[frozenset[str]] | None = None  # sets of variables that are unbound together, where these are known

    def val(self, name: str) -> Val | None:
        if name not in self.vars:
            return None
        i = self.vars[name]
        out = from_columns(name, i.template)
        if i.static:
            out.static = i.static
        return out

    def fields(self, name: str) -> list[str]:
        return [f"{name}__{f}" for f in FIELDS] + ([f"{name}__r"] if self.vars[name].template else [])

    def trimmed(self) -> DataFrame:
        cols = [f"`{c}`" for n in self.vars for c in self.fields(n)]
        return self.df.select(*cols) if cols else self.df.select(F.lit(1).alias("one"))


def _renamed(r: Rel, mark: str) -> tuple[DataFrame, dict[str, Val]]:
    """r with marked column names, so that it can be joined with a relation of the same variables."""
    cols = [F.col(f"`{c}`").alias(mark + c) for n in r.vars for c in r.fields(n)] or [F.lit(1).alias(mark + "one")]
    vals = {}
    for n, i in r.vars.items():
        vals[n] = from_columns(mark + n, i.template)
        if i.static:
            vals[n].static = i.static
    return r.df.select(*cols), vals


def _compatible(a: Val, ia: Info, b: Val, ib: Info) -> Column:
    if ia.template and ib.template and ia.template != ib.template:
        eq = F.lit(False)
    else:
        eq = same(a, b)
    if ia.certain and ib.certain:
        return eq
    free = F.lit(False)
    if not ia.certain:
        free |= a.v.isNull()
    if not ib.certain:
        free |= b.v.isNull()
    return free | F.coalesce(eq, F.lit(False))


class Translator:
    def __init__(self, dataset: Dataset, spark, base: str = "", text=None, vectors=None) -> None:
        self.data, self.spark, self.base, self.text, self.vectors = dataset, spark, base, text, vectors

    # -- joins
    def unit(self) -> Rel:
        return Rel(self.spark.range(1).select(F.lit(1).alias("one")))

    def join(self, a: Rel, b: Rel, how: str = "inner", on: list[Expr] = ()) -> Rel:  # noqa: B006
        """inner, left (OPTIONAL: the filters are part of the condition), semi and anti (EXISTS)."""
        if how == "inner" and not on:
            loose = [(r, n) for n in b.vars if n in a.vars for r in (a, b) if not r.vars[n].certain]
            if 0 < len(loose) <= SPLITS:
                return self.union([self.join(x, y) for x in self.split(a, b) for y in self.split(b, a)])
        right, vals = _renamed(b, "R_")
        shared = [n for n in b.vars if n in a.vars]
        conds = [_compatible(a.val(n), a.vars[n], vals[n], b.vars[n]) for n in shared]

        def scope(n: str) -> Val | None:
            left = a.val(n)
            if left is not None and (a.vars[n].certain or n not in vals):
                return left
            if left is None:
                return vals.get(n)
            v = Val(*(F.coalesce(getattr(left, f), getattr(vals[n], f)) for f in FIELDS))
            return v

        conds += [condition(e, scope, self.base) for e in on]
        cond = reduce(lambda x, y: x & y, conds) if conds else F.lit(True)
        left = a.trimmed()
        if how in ("semi", "anti"):
            return Rel(left.join(right, cond, f"left_{how}"), a.vars)
        joined = left.crossJoin(right) if not conds and how == "inner" else left.join(right, cond, how)
        out, info = [], {}
        for n, i in a.vars.items():
            if n in shared and not i.certain:
                out += [F.coalesce(F.col(f"`{n}__{f}`"), F.col(f"`R_{n}__{f}`")).alias(f"{n}__{f}") for f in FIELDS]
                info[n] = Info(how == "inner" and b.vars[n].certain)
            else:
                out += [F.col(f"`{c}`") for c in a.fields(n)]
                info[n] = i
        for n, i in b.vars.items():
            if n not in a.vars:
                out += [F.col(f"`R_{c}`").alias(c) for c in b.fields(n)]
                info[n] = Info(i.certain and how == "inner", i.template, i.static)
        return Rel(joined.select(*(out or [F.lit(1).alias("one")])), info)

    def split(self, a: Rel, b: Rel) -> list[Rel]:
        """a in parts by which of the variables it shares with b are unbound, so that each part joins by equality alone. In
        a part a variable is either bound in all rows, or left out."""
        names = [n for n in b.vars if n in a.vars and not a.vars[n].certain]
        masks = [m & frozenset(names) for m in a.masks] if a.masks is not None else [frozenset(c) for k in range(len(names) + 1) for c in combinations(names, k)]
        out = []
        for mask in dict.fromkeys(masks):
            cond = reduce(lambda x, y: x & y, (a.val(n).v.isNull() if n in mask else a.val(n).v.isNotNull() for n in names), F.lit(True))
            info = {n: Info(True, i.template, i.static) if n in names else i for n, i in a.vars.items() if n not in mask}
            out.append(Rel(a.df.filter(cond) if names else a.df, info))
        return out

    def minus(self, a: Rel, b: Rel) -> Rel:
        """Rows of a that agree with no row of b on the variables both bind; without a shared bound one, a row stays."""
        shared = [n for n in a.vars if n in b.vars]
        if not shared:
            return a
        right, vals = _renamed(b, "R_")
        cond = reduce(lambda x, y: x & y, (_compatible(a.val(n), a.vars[n], vals[n], b.vars[n]) for n in shared))
        if not any(a.vars[n].certain and b.vars[n].certain for n in shared):
            cond &= reduce(lambda x, y: x | y, (a.val(n).v.isNotNull() & vals[n].v.isNotNull() for n in shared))
        return Rel(a.trimmed().join(right, cond, "left_anti"), a.vars)

    def union(self, parts: list[Rel]) -> Rel:
        names = list(dict.fromkeys(n for p in parts for n in p.vars))
        info = {}
        for n in names:
            own = [p.vars.get(n) for p in parts]
            template = own[0].template if all(i and i.template == own[0].template for i in own) else None
            static = own[0].static if all(i and i.static == own[0].static for i in own) else None
            info[n] = Info(all(i and i.certain for i in own), template, static)
        dfs = []
        for p in parts:
            cols = []
            for n in names:
                keep = [*FIELDS, *(["r"] if info[n].template else [])]
                cols += [F.col(f"`{n}__{f}`") if n in p.vars else null(f).alias(f"{n}__{f}") for f in keep]
            dfs.append(p.df.select(*(cols or [F.lit(1).alias("one")])))
        return Rel(reduce(DataFrame.unionAll, dfs), info)

    # -- basic graph patterns
    def bgp(self, triples: list[Triple], graph) -> Rel:
        stars: dict[Any, list] = {}
        parts: list[Rel] = []
        todo, fresh = list(triples), 0
        while todo:
            t = todo.pop(0)
            p = t.p
            if isinstance(p, Path):
                if p.op == "inv":
                    todo.insert(0, Triple(t.o, p.args[0], t.s))
                elif p.op == "seq":
                    ends = [t.s]
                    for _ in p.args[1:]:
                        fresh += 1
                        ends.append(Variable(f"_p{id(t)}_{fresh}"))
                    ends.append(t.o)
                    todo[:0] = [Triple(a, x, b) for a, x, b in zip(ends, p.args, ends[1:], strict=False)]
                elif p.op == "alt" and all(isinstance(x, Iri) for x in p.args) and len(set(p.args)) == len(p.args):
                    parts.append(self.matched(t.s, [(frozenset(p.args), t.o)], graph)[0])
                elif p.op == "alt":
                    parts.append(self.union([self.bgp([Triple(t.s, x, t.o)], graph) for x in p.args]))
                elif p.op == "neg":
                    parts.append(self.negated(t, graph))
                else:
                    parts.append(self.closure(t, graph))
            else:
                stars.setdefault(t.s, []).append((p, t.o))
        for s, pairs in stars.items():
            parts += self.matched(s, pairs, graph)
        return self.ordered(parts)

    def matched(self, subject, pairs: list, graph) -> list[Rel]:
        out = []
        for m in self.data.star(subject, pairs, graph):
            out.append(Rel(m.df, {n: Info(True, template, static) for n, (template, static) in m.info.items()}))
        return out

    def negated(self, t: Triple, graph) -> Rel:
        ahead = tuple(x for x in t.p.args if isinstance(x, Iri))
        back = tuple(x.args[0] for x in t.p.args if isinstance(x, Path))
        parts = []
        if ahead or not back:
            parts.append(self.matched(t.s, [(ahead, t.o)], graph)[0])
        if back:
            parts.append(self.matched(t.o, [(back, t.s)], graph)[0])
        return self.union(parts) if len(parts) > 1 else parts[0]

    def closure(self, t: Triple, graph) -> Rel:
        """?, + and *: distinct pairs. A constant end is where the search starts."""
        a, b = Variable("_ca"), Variable("_cb")
        step = self.bgp([Triple(a, t.p.args[0], b)], graph)
        pair = step.df.select(identity(step.val("_ca")).alias("a"), identity(step.val("_cb")).alias("b")).distinct()
        nodes = None
        if t.p.op in ("star", "opt"):
            if isinstance(t.s, Variable) and isinstance(t.o, Variable):
                every = self.bgp([Triple(a, Variable("_cp"), b)], graph)
                ids = [every.df.select(identity(every.val(n)).alias("a")) for n in ("_ca", "_cb")]
                nodes = ids[0].union(ids[1]).distinct()
            else:
                end = t.o if isinstance(t.s, Variable) else t.s
                nodes = self.spark.range(1).select(identity(constant(end)).alias("a"))
        start = None if isinstance(t.s, Variable) else identity(constant(t.s))
        goal = None if isinstance(t.o, Variable) else identity(constant(t.o))
        found = paths.reachable(pair, t.p.op, nodes, start, goal)
        rel = Rel(found.select(*_unpacked("a", "_ca"), *_unpacked("b", "_cb")), {"_ca": Info(), "_cb": Info()})
        for name, slot in (("_ca", t.s), ("_cb", t.o)):
            if not isinstance(slot, Variable):
                rel = Rel(rel.df.filter(same(rel.val(name), constant(slot))), rel.vars)
        if isinstance(t.s, Variable) and t.s == t.o:
            rel = Rel(rel.df.filter(same(rel.val("_ca"), rel.val("_cb"))), rel.vars)
        names = {s.name: n for n, s in (("_cb", t.o), ("_ca", t.s)) if isinstance(s, Variable)}
        cols = [c for new, old in names.items() for c in rel.val(old).columns(new)]
        return Rel(rel.df.select(*(cols or [F.lit(1).alias("one")])), {n: Info() for n in names})

    def ordered(self, parts: list[Rel]) -> Rel:
        """Joins the parts: the largest is streamed, and the others are joined to it from the right, where Spark may broadcast
        them, the smallest of those that are connected to what is joined already first."""
        if not parts:
            return self.unit()
        if len(parts) == 1:
            return parts[0]
        size = [bytes_of(p.df) for p in parts]
        left = sorted(range(len(parts)), key=lambda i: size[i])
        out = parts[left.pop()]
        while left:
            i = next((i for i in left if set(parts[i].vars) & set(out.vars)), left[0])
            left.remove(i)
            out = self.join(out, parts[i])
        return out

    # -- groups
    def group(self, g: Group, graph=None, outer: set[str] | None = None) -> Rel:
        rel, late = self.body(g, graph, outer or set())
        return self.filtered(rel, late, graph)

    def body(self, g: Group, graph, outer: set[str]) -> tuple[Rel, list[Expr]]:
        """The group's elements joined in order, and its filters. Neighbouring patterns join as one BGP."""
        rel: Rel | None = None
        pending: list[Triple] = []
        found: list = []  # searches come after the patterns around them, so that these may bind sources

        def flush() -> None:
            nonlocal rel, pending
            if pending:
                plain, asked = searches(pending)
                if plain:
                    part = self.bgp(plain, graph)
                    rel = part if rel is None else self.join(rel, part)
                found[:0] = asked
                pending = []
            for e in found:
                rel = self.with_search(rel, e, graph)
            found.clear()

        for e in g.elements:
            if isinstance(e, BGP):
                pending += e.triples
                continue
            if isinstance(e, TextSearch | VectorSearch | PathSearch):
                found.append(e)
                continue
            flush()
            if isinstance(e, Optional):
                left = rel or self.unit()
                inner, late = self.body(e.pattern, graph, set(left.vars) | outer)
                plain = [f for f in late if not _has_exists(f)]
                inner = self.filtered(inner, [f for f in late if _has_exists(f)], graph)
                rel = self.join(left, inner, "left", plain)
            elif isinstance(e, Minus):
                rel = self.minus(rel or self.unit(), self.group(e.pattern, graph))
            elif isinstance(e, Bind):
                if rel is not None and e.var in rel.vars:
                    raise UnsupportedQuery(f"BIND to ?{e.var}, which is in use")
                rel = self.extend(rel or self.unit(), e.var, e.expr)
            else:
                part = self.element(e, graph)
                rel = part if rel is None else self.join(rel, part)
        flush()
        return rel or self.unit(), g.filters

    def element(self, e, graph) -> Rel:
        if isinstance(e, Group):
            return self.group(e, graph)
        if isinstance(e, Union):
            return self.union([self.group(b, graph) for b in e.branches])
        if isinstance(e, Graph):
            return self.group(e.pattern, e.name)
        if isinstance(e, Values):
            return self.values(e)
        if isinstance(e, Select):
            return self.select(e, graph)
        raise UnsupportedQuery(type(e).__name__)

    def values(self, e: Values) -> Rel:
        rows, schema = [], ", ".join(f"`{n}__{f}` {TYPES[f]}" for n in e.names for f in FIELDS) or "one int"
        for row in e.rows:
            out = []
            for t in row:
                if t is None:
                    out += [None] * len(FIELDS)
                    continue
                kind = {Iri: "iri", Blank: "blank"}.get(type(t), "literal")
                d, lang = (None, None) if kind != "literal" else (t.datatype, t.lang)
                out += [kind, t.value, d, lang, None, None]
            rows.append(tuple(out) or (1,))
        df = self.spark.createDataFrame(rows, schema)
        from quadweave.sources.datasets import literal_fields

        for n in e.names:
            own = literal_fields(F.col(f"`{n}__v`"), F.col(f"`{n}__d`"))
            df = df.withColumns({f"{n}__{f}": c for f, c in own.items()})
        certain = [all(r[i] is not None for r in e.rows) for i in range(len(e.names))]
        masks = dict.fromkeys(frozenset(n for n, t in zip(e.names, r, strict=True) if t is None) for r in e.rows)
        return Rel(F.broadcast(df) if len(rows) < 10_000 else df, {n: Info(c) for n, c in zip(e.names, certain, strict=True)}, list(masks) or None)

    def with_search(self, rel: Rel | None, e, graph) -> Rel:
        """rel joined with the hits of a search. Where rel binds the sources, and these are few beside what is searched, only
        their chunks are scored; a search with a window is not cut, as its window is one of all hits."""
        name = e.variables.get("source")
        chunks = self.text if isinstance(e, TextSearch) else self.vectors
        if rel is None:
            return self.search(e, chunks, graph)
        if name in rel.vars and rel.vars[name].certain and chunks is not None and not {"limit", "offset"} & set(e.options):
            bound = rel.df.select(rel.val(name).v.alias("source")).distinct()
            if bytes_of(bound) * FEW < bytes_of(chunks):
                chunks = chunks.join(bound, "source", "left_semi")
        return self.join(rel, self.search(e, chunks, graph))

    def search(self, e, chunks: DataFrame | None, graph) -> Rel:
        from quadweave.operators import search

        if isinstance(e, PathSearch):
            a, b = Variable("_sa"), Variable("_sb")
            steps = [(p, self.bgp([Triple(a, Iri(p), b)], graph)) for p in e.via]
            if not e.via:
                every = self.bgp([Triple(a, Variable("_sp"), b)], graph)
                steps = [(every.val("_sp").v, every)]
            edges = [r.df.filter(r.val("_sb").k == "iri").select(r.val("_sa").v.alias("s"), (F.lit(p) if isinstance(p, str) else p).alias("p"), r.val("_sb").v.alias("o")) for p, r in steps]
            hits, _ = paths.search_paths(reduce(DataFrame.union, edges), e.start, **{"most": None} | e.options)
            hits = hits.select(F.array_join("nodes", " ").alias("nodes"), F.array_join("predicates", " ").alias("predicates"), "length")
        else:
            if chunks is None:
                raise UnsupportedQuery("there is nothing to search in")
            hits = (search.text_hits if isinstance(e, TextSearch) else search.vector_hits)(chunks, e)
        vals = search.as_terms(hits, e.variables)
        return Rel(hits.select(*(c for n, v in vals.items() for c in v.columns(n))), {n: Info(True) for n in vals})

    def extend(self, rel: Rel, name: str, e: Expr) -> Rel:
        v = compile_expr(e, rel.val, self.base)
        rest = [F.col(f"`{c}`") for n in rel.vars for c in rel.fields(n)]
        static = getattr(v, "static", None) if e.op == "var" else None
        info = Info(e.op == "term" or e.op == "var" and e.name in rel.vars and rel.vars[e.name].certain, v.template, static)
        return Rel(rel.df.select(*rest, *v.columns(name)), rel.vars | {name: info})

    def filtered(self, rel: Rel, filters: list[Expr], graph) -> Rel:
        for f in filters:
            for c in _conjuncts(f):
                rel = self.filter_one(rel, c, graph)
        return rel

    def filter_one(self, rel: Rel, f: Expr, graph) -> Rel:
        negated = f.op == "notexists"
        while f.op == "not" and _has_exists(f.args[0]) and f.args[0].op in ("not", "exists", "notexists"):
            f = f.args[0]
            negated = not negated if f.op != "notexists" else negated
        if f.op in ("exists", "notexists"):
            inner, late = self.body(f.args[0], graph, set(rel.vars))
            return self.join(rel, inner, "anti" if negated else "semi", late)
        if _has_exists(f):
            return self.filter_mixed(rel, f, graph)
        return Rel(rel.df.filter(condition(f, rel.val, self.base)), rel.vars)

    def filter_mixed(self, rel: Rel, f: Expr, graph) -> Rel:
        """EXISTS within a larger expression: its truth becomes a column of each row. Rows that agree on the variables of the
        inner pattern agree on its truth, so it is found once for each of their values and joined back by these."""
        marks = []

        def swap(e: Expr) -> Expr:
            if e.op in ("exists", "notexists"):
                marks.append(e)
                test = Expr("var", name=f"mark_{len(marks)}")
                return Expr("not", [test]) if e.op == "notexists" else test
            return Expr(e.op, [swap(a) if isinstance(a, Expr) else a for a in e.args], e.name, e.distinct)

        test = swap(f)
        df = rel.df
        vals: dict[str, Val] = {}
        for i, e in enumerate(marks, 1):
            inner, late = self.body(e.args[0], graph, set(rel.vars))
            used = {n: x for n, x in rel.vars.items() if n in variables(e.args[0]) | set(inner.vars)}
            keys = [f"{n}__r" if x.template else f"{n}__{f}" for n, x in used.items() for f in (("r",) if x.template else ("k", "v", "d", "l"))]
            values = rel.df.select(*(F.col(f"`{c}`") for n in used for c in rel.fields(n)), *([] if used else [F.lit(1).alias("one")])).distinct()
            hits = self.join(Rel(values, used), inner, "semi", late).df.select(*(F.col(f"`{k}`").alias(f"E_{k}") for k in keys), F.lit(True).alias(f"mark_{i}")).distinct()
            met = reduce(lambda x, y: x & y, (F.col(f"`{k}`").eqNullSafe(F.col(f"`E_{k}`")) for k in keys), F.lit(True))
            df = df.join(hits, met, "left").drop(*(f"E_{k}" for k in keys))
            from quadweave.terms import boolean

            vals[f"mark_{i}"] = boolean(F.coalesce(F.col(f"mark_{i}"), F.lit(False)))
        return Rel(df.filter(condition(test, lambda n: vals.get(n) or rel.val(n), self.base)), rel.vars)

    # -- SELECT
    def select(self, s: Select, graph=None) -> Rel:
        rel = self.group(s.pattern, graph)
        if s.values:
            rel = self.join(rel, self.values(s.values))
        projection = s.projection
        if projection is None:
            projection = [(n, None) for n in rel.vars if not n.startswith("_")]
        aggregated = s.group is not None or s.having or any(e is not None and _has_agg(e) for _, e in projection) or any(_has_agg(e) for e, _ in s.order)
        having, order = list(s.having), list(s.order)
        if aggregated:
            rel, projection, having, order = self.aggregate(rel, s, projection)
        for f in having:
            rel = self.filter_one(rel, f, graph)
        for n, e in projection:
            if e is not None and not (e.op == "var" and e.name == n):
                rel = self.extend(rel, n, e)
        keys = []
        for i, (e, desc) in enumerate(order):
            if e.op != "var":
                rel = self.extend(rel, f"_o{i}", e)
                e = Expr("var", name=f"_o{i}")
            v = rel.val(e.name)
            if v is not None:
                known = getattr(v, "static", None)
                simple = {"n": v.n, "t": v.t, "v": v.v}.get(known)
                keys += order_keys(v, desc) if simple is None else [simple.desc_nulls_last() if desc else simple.asc_nulls_first()]
        names = [n for n, _ in projection]
        info = {n: rel.vars.get(n, Info(False)) for n in names}
        out = Rel(rel.df, {n: i for n, i in rel.vars.items() if n in info})
        missing = [n for n in names if n not in rel.vars]
        sort_first = keys and not s.distinct
        if sort_first:
            out = Rel(out.df.orderBy(*keys), out.vars)
        cols = [F.col(f"`{c}`") for n in names if n in out.vars for c in out.fields(n)] + [null(f).alias(f"{n}__{f}") for n in missing for f in FIELDS]
        df = out.df.select(*(cols or [F.lit(1).alias("one")]))
        out = Rel(df, {n: (out.vars[n] if n in out.vars else Info(False)) for n in names})
        if s.distinct:
            df = out.df.dropDuplicates([f"{n}__{f}" for n in names for f in ("k", "v", "d", "l")]) if names else out.df.distinct()
            if keys:
                if any(e.op != "var" or e.name not in names for e, _ in order):
                    raise UnsupportedQuery("ORDER BY of DISTINCT rows takes selected variables")
                df = df.orderBy(*keys)
            out = Rel(df, out.vars)
        if s.offset:
            out = Rel(out.df.offset(s.offset), out.vars)
        if s.limit is not None:
            out = Rel(out.df.limit(s.limit), out.vars)
        return out

    # -- aggregation
    def aggregate(self, rel: Rel, s: Select, projection: list):
        keys = []
        for i, (e, name) in enumerate(s.group or []):
            name = name or f"_g{i}"
            if e.op != "var" or e.name != name:
                rel = self.extend(rel, name, e)
            elif name not in rel.vars:
                rel = Rel(rel.df.select("*", *[null(f).alias(f"{name}__{f}") for f in FIELDS]), rel.vars | {name: Info(False)})
            keys.append((name, e))
        aggs: list[tuple[str, Expr]] = []

        def lift(e: Expr) -> Expr:
            for i, (_, g) in enumerate(keys):
                if g.op != "var" and g == e:
                    return Expr("var", name=keys[i][0])
            if e.op == "agg":
                for n, known in aggs:
                    if known == e:
                        return Expr("var", name=n)
                aggs.append((f"_a{len(aggs)}", e))
                return Expr("var", name=aggs[-1][0])
            return Expr(e.op, [lift(a) if isinstance(a, Expr) else a for a in e.args], e.name, e.distinct)

        projection = [(n, lift(e) if e is not None else None) for n, e in projection]
        having = [lift(h) for h in s.having]
        order = [(lift(e), d) for e, d in s.order]
        grouped = {n for n, _ in keys}
        for n, e in projection:
            loose = ({n} if e is None else variables(e)) - grouped - {a for a, _ in aggs} - {x for x, _ in projection if x != n}
            if loose:
                raise UnsupportedQuery(f"?{loose.pop()} is neither grouped nor aggregated")
        columns, finish, static = [], {}, {}
        df = rel.df
        for n, e in aggs:
            cols, build = self.one_aggregate(rel, n, e)
            columns += cols
            finish[n] = build
        by = [F.col(f"`{c}`") for n, _ in keys for c in rel.fields(n)]
        out = df.groupBy(*by).agg(*(columns or [F.count(F.lit(1)).alias("n_")]))
        vals = {n: build() for n, build in finish.items()}
        out = out.select(*by, *(c for n, v in vals.items() for c in v.columns(n)))
        info = {n: rel.vars[n] for n, _ in keys} | {n: Info(e.name in ("COUNT", "SUM") or bool(s.group) and self.always(rel, e), None, "n" if e.name in ("COUNT", "SUM", "AVG") else static.get(n)) for n, e in aggs}
        return Rel(out, info), projection, having, order

    def always(self, rel: Rel, e: Expr) -> bool:
        """Whether an aggregate of a group, which has a row at least, is bound: it takes a variable that is always bound."""
        arg = e.args[0] if e.args else None
        certain = isinstance(arg, Expr) and arg.op == "var" and arg.name in rel.vars and rel.vars[arg.name].certain
        return certain and (e.name in ("MIN", "MAX", "SAMPLE", "GROUP_CONCAT") and not rel.vars[arg.name].template or e.name == "AVG" and rel.vars[arg.name].static == "n")

    def one_aggregate(self, rel: Rel, n: str, e: Expr):
        c = f"{n}_"
        if e.name == "COUNT":
            if not e.args:
                what = F.struct(*(F.coalesce(F.col(f"`{x}__{f}`"), F.lit("")) for x in rel.vars if not x.startswith("_") for f in ("k", "v", "d", "l")), F.lit(0))
                col = F.count_distinct(what) if e.distinct else F.count(F.lit(1))
            else:
                v = compile_expr(e.args[0], rel.val, self.base)
                if e.distinct and v.template:
                    col = F.count_distinct(v.r)
                elif e.distinct and getattr(v, "static", None):
                    col = F.count_distinct(v.v)
                else:
                    col = F.count_distinct(identity(v)) if e.distinct else F.count(v.r if v.template else v.v)
            return [col.alias(c)], lambda: make(F.lit("literal"), F.col(c).cast("string"), XSD + "integer", None, F.col(c).cast("double"))
        v = compile_expr(e.args[0], rel.val, self.base)
        if e.name in ("SUM", "AVG"):
            if e.distinct:
                items = F.collect_set(F.when(v.n.isNotNull(), F.struct(v.v.alias("v"), v.d.alias("d"), v.n.alias("n"))))
                total = F.aggregate(items, F.lit(0.0), lambda acc, x: acc + x["n"])
                cols = [total.alias(c + "s"), F.size(items).alias(c + "n"), F.max(F.when(v.n.isNotNull() & ~v.d.isin(INTEGER_IRIS), v.d)).alias(c + "d")]
            else:
                cols = [F.sum(v.n).alias(c + "s"), F.count(v.n).alias(c + "n"), F.max(F.when(v.n.isNotNull() & ~v.d.isin(INTEGER_IRIS), v.d)).alias(c + "d")]
            if e.name == "SUM":
                # Doubles lose digits of large integers, whose sum is taken apart.
                whole = F.try_sum(digits(v)) if not e.distinct else F.aggregate(items, F.lit(0).cast("decimal(38,0)"), lambda acc, x: F.try_add(acc, F.when(x["d"].isin(INTEGER_IRIS), x["v"].try_cast("decimal(38,0)"))).cast("decimal(38,0)"))
                cols.append(whole.alias(c + "w"))
                return cols, lambda: number(F.coalesce(F.col(c + "s"), F.lit(0.0)), F.coalesce(F.col(c + "d"), F.lit(XSD + "integer")), F.when(F.col(c + "d").isNull(), F.col(c + "w")))
            mean = lambda: F.when(F.col(c + "n") > 0, F.col(c + "s") / F.when(F.col(c + "n") > 0, F.col(c + "n")))
            return cols, lambda: number(mean(), F.coalesce(F.col(c + "d"), F.lit(XSD + "decimal")))
        whole = F.struct(*(getattr(v, f).alias(f) for f in FIELDS))
        unpack = lambda: Val(*(F.col(f"{c}.{f}") for f in FIELDS))
        if e.name in ("MIN", "MAX"):
            rank = F.struct(F.when(v.k == "blank", 1).when(v.k == "iri", 2).otherwise(3), F.coalesce(v.n, v.t.cast("double")).isNull(), F.coalesce(v.n, v.t.cast("double")), v.v, F.coalesce(v.d, F.lit("")))
            f = F.min_by if e.name == "MIN" else F.max_by
            return [f(whole, F.when(v.v.isNotNull(), rank)).alias(c)], unpack
        if e.name == "SAMPLE":
            return [F.min_by(whole, F.when(v.v.isNotNull(), F.struct(v.v, F.coalesce(v.d, F.lit(""))))).alias(c)], unpack
        separator = e.args[1].args[0].value if len(e.args) > 1 else " "
        items = (F.collect_set if e.distinct else F.collect_list)(v.v)
        return [F.array_join(F.array_sort(items), separator).alias(c)], lambda: string(F.col(c))

    # -- forms
    def triples(self, template: list[Triple], rel: Rel) -> DataFrame:
        """CONSTRUCT: the template filled in by each row, without duplicates; rows that leave a slot unbound or ill-typed
        add nothing; a blank node of the template is a new one for each row."""
        needs_row = any(isinstance(x, Variable) and x.name.startswith(("_b", "_n")) for t in template for x in (t.s, t.o))
        df = rel.df.withColumn("row_", F.uuid()) if needs_row else rel.df

        def slot(x) -> Val:
            if isinstance(x, Variable):
                if x.name.startswith(("_b", "_n")) and x.name not in rel.vars:
                    return make("blank", F.concat(F.lit(x.name), F.lit("_"), F.col("row_")))
                return rel.val(x.name) or Val(*(null(f) for f in FIELDS))
            return constant(x)

        items = []
        for t in template:
            s, p, o = slot(t.s), slot(t.p), slot(t.o)
            good = s.k.isin("iri", "blank") & (p.k == "iri") & o.v.isNotNull()
            items.append(F.when(good, F.struct(s.k.alias("sk"), s.v.alias("s"), p.v.alias("p"), o.k.alias("ok"), o.v.alias("o"), o.d.cast("string").alias("od"), o.l.cast("string").alias("ol"))))
        return df.select(F.explode(F.array(*items)).alias("x")).filter("x is not null").select("x.*").distinct()

    def describe(self, q: Query) -> DataFrame:
        """All triples whose subject is a target."""
        every = self.bgp([Triple(Variable("s"), Variable("p"), Variable("o"))], None)
        named = [t for t in q.targets if isinstance(t, Iri)]
        wanted = [v.name for v in q.targets if isinstance(v, Variable)]
        ids = self.spark.createDataFrame([("iri", t.value) for t in named], "tk string, tv string")
        if q.select.pattern.elements:
            rel = self.select(Select(q.select.pattern, None, limit=q.select.limit, offset=q.select.offset))
            for n in wanted or list(rel.vars):
                if n in rel.vars:
                    ids = ids.union(rel.df.select(rel.val(n).k, rel.val(n).v))
        s, p, o = every.val("s"), every.val("p"), every.val("o")
        df = every.df.join(ids, (s.v == F.col("tv")) & (s.k == F.col("tk")), "left_semi")
        return df.select(s.k.alias("sk"), s.v.alias("s"), p.v.alias("p"), o.k.alias("ok"), o.v.alias("o"), o.d.alias("od"), o.l.alias("ol")).distinct()

    def query(self, q: Query) -> Rel | DataFrame:
        if q.default_graphs or q.named_graphs:
            self.data = self.data.with_graphs(q.default_graphs, q.named_graphs)
        if q.form == "select":
            return self.select(q.select)
        if q.form == "ask":
            rel = self.select(Select(q.select.pattern, [], limit=1))
            return rel.df.agg((F.count(F.lit(1)) > 0).alias("boolean"))
        if q.form == "construct":
            names = sorted({x.name for t in q.template for x in (t.s, t.p, t.o) if isinstance(x, Variable)})
            rel = self.select(Select(q.select.pattern, None, order=q.select.order, limit=q.select.limit, offset=q.select.offset)) if q.select.limit is not None or q.select.offset else self.group(q.select.pattern)
            return self.triples(q.template, Rel(rel.df, {n: i for n, i in rel.vars.items() if n in names}))
        return self.describe(q)


def bytes_of(df: DataFrame) -> int:
    """Spark's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def searches(triples: list[Triple]) -> tuple[list[Triple], list]:
    """Triples apart from those that ask for a search, and the searches."""
    asked: dict[Any, list[Triple]] = {}
    plain = []
    for t in triples:
        if isinstance(t.p, Iri) and t.p.value.startswith(SEARCH):
            asked.setdefault(t.s, []).append(t)
        else:
            plain.append(t)
    out = []
    for s, own in asked.items():
        if not isinstance(s, Variable) or not s.name.startswith(("_b", "_n")) or any(s in (t.s, t.o) for t in plain):
            raise UnsupportedQuery("a search is a blank node of its own")
        names, options, what, via = {}, {}, {}, []
        for t in own:
            name = t.p.value[len(SEARCH) :]
            if isinstance(t.o, Variable):
                names[{"chunkKey": "chunk_key", "startOffset": "start_offset", "endOffset": "end_offset"}.get(name, name)] = t.o.name
            elif name in ("text", "vector", "from"):
                what[name] = t.o.value
            elif name == "via":
                via.append(t.o.value)
            elif name in OPTIONS:
                number = getattr(t.o, "datatype", None)
                options[OPTIONS[name]] = t.o.value if number is None else int(t.o.value) if number in INTEGER_IRIS else float(t.o.value)
            else:
                raise UnsupportedQuery(f"a search has no {name}")
        if len(what) != 1:
            raise UnsupportedQuery("a search has one of text, vector and from")
        if "text" in what:
            out.append(TextSearch(what["text"], names, options))
        elif "vector" in what:
            out.append(VectorSearch([float(x) for x in what["vector"].replace(",", " ").split()], names, options))
        else:
            if "limit" in options:
                options["most"] = options.pop("limit")
            out.append(PathSearch(what["from"], names, via, options))
    return plain, out


def _unpacked(column: str, name: str) -> list[Column]:
    from quadweave.sources.datasets import literal_fields

    k, v = F.col(f"{column}.k"), F.col(f"{column}.v")
    d, lang = (F.when(F.col(f"{column}.{f}") != "", F.col(f"{column}.{f}")) for f in ("d", "l"))
    return Val(k, v, d, lang, **literal_fields(v, d)).columns(name)


def _conjuncts(e: Expr) -> list[Expr]:
    return [x for a in e.args for x in _conjuncts(a)] if e.op == "&&" else [e]


def _has_exists(e: Expr) -> bool:
    return e.op in ("exists", "notexists") or any(isinstance(a, Expr) and _has_exists(a) for a in e.args)


def _has_agg(e: Expr) -> bool:
    return e.op == "agg" or any(isinstance(a, Expr) and _has_agg(a) for a in e.args)


__all__ = ["Info", "Rel", "Translator", "Window", "n_triples"]
