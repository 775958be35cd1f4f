"""Statistics of quads: distributions and the schema explorer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadweave.storage import cut
from quadweave.terms import LANG_STRING, TYPE, XSD


def distribution(quads: DataFrame, by: list[str], top: int | None = None) -> DataFrame:
    """Quads and distinct subjects, predicates and objects per graph, predicate, or pair of slots; most frequent first."""
    other = [(c, n) for c, n in (("s", "subjects"), ("p", "predicates"), ("o", "objects"), ("g", "graphs")) if c not in by]
    cols = [F.count_distinct(F.struct("ok", "o", F.coalesce("od", F.lit("")), F.coalesce("ol", F.lit(""))) if c == "o" else F.col(c)).alias(n) for c, n in other]
    df = quads.groupBy(*by).agg(F.count("*").alias("quads"), *cols)
    return df.orderBy(F.desc("quads"), *by).limit(top) if top else df


def datatypes(quads: DataFrame) -> DataFrame:
    """datatype, distinct literals, uses"""
    d = F.when(F.col("ol").isNotNull(), LANG_STRING).otherwise(F.coalesce("od", F.lit(XSD + "string")))
    rows = quads.filter("ok = 'literal'").select(d.alias("datatype"), "o", F.coalesce("ol", F.lit("")).alias("ol"))
    return rows.groupBy("datatype").agg(F.count_distinct(F.struct("o", "ol")).alias("literals"), F.count("*").alias("uses"))


def explore(quads: DataFrame, kind: str, text: str = "", prefix: str = "", top: int = 50) -> DataFrame:
    """Graphs, predicates, classes or terms with their numbers of quads; text is looked for without case."""
    df = {
        "graphs": quads.select(F.col("g").alias("term")),
        "predicates": quads.select(F.col("p").alias("term")),
        "classes": quads.filter(F.col("p") == TYPE).select(F.col("o").alias("term")),
        "terms": quads.select(F.col("s").alias("term")).union(quads.select("o")),
    }[kind]
    if text:
        df = df.filter(F.contains(F.lower("term"), F.lit(text.lower())))
    if prefix:
        df = df.filter(F.col("term").startswith(prefix))
    return df.groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top)


def projection(quads: DataFrame, by: list[str]) -> DataFrame:
    """Stored counts of quads by some of their slots (one to three of g, s, p, o)."""
    return cut(quads.groupBy(*by).agg(F.count("*").alias("quads")))


def refreshed(kept: DataFrame, quads: DataFrame, by: list[str], dirty: DataFrame) -> DataFrame:
    """A projection after changes: only groups of the dirty graphs (column g, which `by` must hold) are counted again."""
    new = quads.join(dirty, "g", "left_semi").groupBy(*by).agg(F.count("*").alias("quads"))
    return cut(kept.join(dirty, "g", "left_anti").unionByName(new))


def compound(quads: DataFrame, field: str, patterns: list) -> DataFrame:
    """Rows of several patterns (conditions on quads) that agree on one field and on the graph."""
    out = None
    for i, cond in enumerate(patterns):
        part = quads.filter(cond).select("g", field, *(F.col(c).alias(f"{c}{i}") for c in ("s", "p", "o") if c != field))
        out = part if out is None else out.join(part, ["g", field])
    return out


def attributes(quads: DataFrame, predicates: list[str], subjects: DataFrame | None = None) -> DataFrame:
    """One row per subject with the sorted values of each predicate: many optional patterns in one pass."""
    df = quads.filter(F.col("p").isin(predicates))
    if subjects is not None:
        df = df.join(subjects, "s", "left_semi")
    return df.groupBy("s").pivot("p", predicates).agg(F.array_sort(F.collect_list("o")))


def within_budget(entries: DataFrame, budget: int, size: str, order: list) -> DataFrame:
    """Entries that fit a byte budget, the most recently used first; what comes after the budget is spent is left out.
    Entries are sorted in ranges; sums of whole ranges, a row a partition, tell what is spent before each."""
    laid = cut(entries.repartitionByRange(*order).withColumn("range_", F.spark_partition_id()))
    sums = laid.groupBy("range_").agg(F.sum(size).alias("n_"))  # a row a partition
    ahead = sums.select("range_", F.coalesce(F.sum("n_").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead_")).filter(F.col("ahead_") <= budget)
    spent = F.sum(size).over(Window.partitionBy("range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = laid.join(F.broadcast(ahead), "range_").withColumn("spent", F.col("ahead_") + spent)
    return out.filter(F.col("spent") <= budget).select(*entries.columns, "spent")


def same_rows(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What either side has more of: two engines or versions agree if both are empty."""
    return a.exceptAll(b), b.exceptAll(a)
