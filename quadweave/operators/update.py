"""Updates. Quads are immutable DataFrames: an update yields a delta and a new DataFrame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.plans.algebra import Group, Update
from quadweave.plans.parser import parse_update
from quadweave.plans.translate import Rel, Translator
from quadweave.sources.datasets import QUADS, QuadDataset
from quadweave.storage import cut
from quadweave.terms import Blank, Iri, Variable, constant

KEY = ["g", "sk", "s", "p", "ok", "o", "od", "ol"]


def _same(a: str, b: str):
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEY))


def minus(quads: DataFrame, gone: DataFrame) -> DataFrame:
    return quads.alias("a").join(gone.select(*KEY).alias("b"), _same("a", "b"), "left_anti")


def once(new: DataFrame) -> DataFrame:
    """One row of each quad: that of the first source."""
    first = F.row_number().over(Window.partitionBy(*KEY).orderBy("source"))
    return new.withColumn("rank_", first).filter("rank_ = 1").drop("rank_")


def insert(quads: DataFrame, new: DataFrame) -> DataFrame:
    """Adds quads; of one with the same four terms the new row stays, with its source. Only the new ones are sorted out: what
    is there is matched with them, by a broadcast where Spark finds them small."""
    new = once(new)
    return minus(quads, new).unionByName(new)


def replace_source(quads: DataFrame, source: str, new: DataFrame) -> DataFrame:
    return insert(delete_source(quads, source), new.withColumn("source", F.lit(source)))


def delete_source(quads: DataFrame, source: str) -> DataFrame:
    return quads.filter(~F.col("source").eqNullSafe(F.lit(source)))


def move_source(quads: DataFrame, old: str, new: str) -> DataFrame:
    return delete_source(quads, new).withColumn("source", F.when(F.col("source") == old, new).otherwise(F.col("source")))


def apply_delta(quads: DataFrame, delta: DataFrame) -> DataFrame:
    """delta: op (delete or insert) and a quad; deletes come first. The delta is made once, and one pass over the quads takes
    out what it deletes and what it replaces."""
    delta = cut(delta)
    new = once(delta.filter("op = 'insert'").select(*quads.columns))
    return minus(quads, delta.select(*KEY).distinct()).unionByName(new)


def rewrite_terms(quads: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Renames IRIs under a prefix where it ends at the end, '#' or '/': (quads, skipped IRIs that merely begin like it)."""
    at_edge = lambda c: (c == old) | c.startswith(old + "#") | c.startswith(old + "/") | (c.startswith(old) if old[-1:] in "#/" else F.lit(False))
    renamed = lambda c: F.when(at_edge(c), F.concat(F.lit(new), F.substr(c, F.lit(len(old) + 1)))).otherwise(c)
    out = quads
    for k, c in ((None, "g"), ("sk", "s"), (None, "p"), ("ok", "o")):
        cond = F.lit(True) if k is None else F.col(k) == "iri"
        out = out.withColumn(c, F.when(cond, renamed(F.col(c))).otherwise(F.col(c)))
    every = reduce(DataFrame.union, (quads.filter(F.lit(True) if k is None else F.col(k) == "iri").select(F.col(c).alias("iri")) for k, c in ((None, "g"), ("sk", "s"), (None, "p"), ("ok", "o"))))
    skipped = every.filter(F.col("iri").startswith(old) & ~at_edge(F.col("iri"))).distinct()
    return out, skipped


def _ground(spark, quads: list) -> DataFrame:
    rows = []
    for g, t in quads:
        o = t.o
        s = Blank(t.s.name) if isinstance(t.s, Variable) else t.s
        o = Blank(o.name) if isinstance(o, Variable) and o.name.startswith(("_b", "_n")) else o
        kinds = [{Iri: "iri", Blank: "blank"}.get(type(x), "literal") for x in (s, o)]
        rows.append((g.value if g else "", kinds[0], s.value, t.p.value, kinds[1], o.value, getattr(o, "datatype", None), getattr(o, "lang", None), None, None))
    return spark.createDataFrame(rows, QUADS)


def _filled(translator: Translator, template: list, rel: Rel, default: str) -> DataFrame:
    """Template quads filled in by each row."""
    parts = []
    groups: dict = {}
    for g, t in template:
        groups.setdefault(g, []).append(t)
    for g, triples in groups.items():
        if isinstance(g, Variable):
            graph = rel.val(g.name)
            rows = rel.df.filter(graph.k == "iri")
            for t in triples:
                s, p, o = (rel.val(x.name) if isinstance(x, Variable) else constant(x) for x in (t.s, t.p, t.o))
                good = s.k.isin("iri", "blank") & (p.k == "iri") & o.v.isNotNull()
                parts.append(rows.filter(good).select(graph.v.alias("g"), s.k.alias("sk"), s.v.alias("s"), p.v.alias("p"), o.k.alias("ok"), o.v.alias("o"), o.d.cast("string").alias("od"), o.l.cast("string").alias("ol")).distinct())
        else:
            parts.append(translator.triples(triples, rel).select(F.lit(g.value if g else default).alias("g"), "*"))
    df = reduce(DataFrame.union, parts)
    return df.withColumn("source", F.lit(None).cast("string")).withColumn("line", F.lit(None).cast("int"))


def _graph(quads: DataFrame, ref) -> DataFrame:
    if ref == "ALL":
        return quads
    if ref == "NAMED":
        return quads.filter("g != ''")
    return quads.filter(F.col("g") == ("" if ref == "DEFAULT" else ref.value))


def delta_of(spark, quads: DataFrame, u: Update) -> DataFrame:
    """What one operation deletes and inserts: op and a quad. Nothing is applied."""
    none = spark.createDataFrame([], QUADS)
    gone, new = none, none
    if u.op == "insert_data":
        new = _ground(spark, u.insert)
    elif u.op == "delete_data":
        gone = _ground(spark, u.delete)
    elif u.op in ("clear", "drop"):
        gone = _graph(quads, u.target)
    elif u.op in ("add", "copy", "move"):
        if u.source != u.target:
            new = _graph(quads, u.source).withColumn("g", F.lit("" if u.target == "DEFAULT" else u.target.value))
            if u.op != "add":
                gone = _graph(quads, u.target)
            if u.op == "move":
                gone = gone.union(_graph(quads, u.source))
    elif u.op == "modify":
        data = QuadDataset(quads=quads)
        if u.using or u.using_named:
            data = data.with_graphs(u.using, u.using_named)
        elif u.with_graph:
            data = QuadDataset(quads=quads, graphs=(u.with_graph,))
        t = Translator(data, spark)
        rel = t.group(u.pattern or Group())
        default = u.with_graph or ""
        if u.delete and u.insert:
            rel = Rel(cut(rel.trimmed()), rel.vars)  # both templates read the same solutions
        gone = _filled(t, u.delete, rel, default) if u.delete else none
        new = _filled(t, u.insert, rel, default) if u.insert else none
    return gone.select(F.lit("delete").alias("op"), *quads.columns).union(new.select(F.lit("insert").alias("op"), *quads.columns))


def update(spark, quads: DataFrame, text: str, base: str = "") -> DataFrame:
    """The quads after a SPARQL update request."""
    for u in parse_update(text, base):
        quads = apply_delta(quads, delta_of(spark, quads, u))
    return quads
