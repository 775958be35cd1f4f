"""A corpus pipeline of five stages over the operators of quadweave.llm; each stage works on all that the one before kept.

Filters decide on rows. A null text is an empty one: it is never toxic, near anything or contaminated, and one of all empty
texts stays. Rows with a null or repeated doc_id are kept or dropped like others. Whole texts of any length are looked at.
Empty tables, of documents, labels or benchmark, give empty results or drop nothing. Other columns of documents pass through
the filters, whatever their names; the mix has columns of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadweave.llm import toxicity
from quadweave.llm.decontam import contamination
from quadweave.llm.exact import exact_groups
from quadweave.llm.mixing import mixture
from quadweave.llm.near import near_groups
from quadweave.llm.shared import checked, fold, forget, scratch, table, without, written

def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """docs with a key of each row, so that decisions reach rows whatever their doc_id, null and repeated ones included; a
    view of what operators read, (row, doc_id, text); and the key's name, which is none of docs' own.

    Rows of Parquet files are numbered by file and place in it, which every later read finds alike, in any number of tasks.
    Rows from anywhere else are written once."""
    row, file, place = (_free(n, docs) for n in ("row_key", "row_file", "row_place"))
    rows = None
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        where = docs.metadataColumn("_metadata")
        placed = docs.select("*", F.xxhash64(where["file_path"]).alias(file), where["row_index"].alias(place))
        names = docs.select(where["file_path"].alias("name")).distinct().select("name", F.xxhash64("name").alias(file))
        number = (F.row_number().over(Window.orderBy("name")) - 1).cast("long")
        files = written(names.select(file, number.alias(row)), "files")  # a row a file
        if files.select(file).distinct().count() == files.count():
            key = F.col(row) * F.lit(1 << 40) + F.col(place)
            rows = placed.join(checked(files, 24), file).select(*(F.col(f"`{c}`") for c in docs.columns), key.alias(row))
    if rows is None:
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    return rows, rows.select(F.col(row).alias("row"), "doc_id", "text"), row


def _free(name: str, docs: DataFrame) -> str:
    while name in docs.columns:
        name += "_"
    return name


def kept(rows: DataFrame, drop: DataFrame, row: str, name: str) -> DataFrame:
    """The rows whose key is not in the one column of drop, without the key."""
    return without(rows, written(drop, name), row).drop(row)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. Labels are learned from the folds that the toxicity query learns from."""
    fitted = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1))
    rows, view, row = keyed(docs)
    return kept(rows, toxicity.score(view, fitted, id_col="row").filter(F.col("score") >= toxicity.THRESHOLD).select("id"), row, "toxic")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts: that of the largest doc_id; one without an id if no other has one."""
    rows, view, row = keyed(docs)
    ranked = view.select(F.struct(F.col("doc_id").isNotNull().alias("has_id"), "doc_id", "row").alias("rank"), "text")
    return kept(rows, exact_groups(ranked, id_col="rank", keep="max").filter("not kept").select(F.col("id.row").alias("id")), row, "copies")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near-duplicates: that of the smallest doc_id; one without an id if no other has one."""
    rows, view, row = keyed(docs)
    linked = written(near_groups(view, id_col="row").filter("not kept").select("id", "component_id"), "near_copies")
    members = linked.union(linked.select("component_id", "component_id").distinct())
    ranked = view.select("row", "doc_id").join(checked(members, 32), F.col("row") == F.col("id")).select("id", "component_id", F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row").alias("rank"))
    ranked = written(ranked, "near_ranked")
    first = ranked.groupBy("component_id").agg(F.min("rank").alias("first"))
    return kept(rows, ranked.join(first, "component_id").filter(F.col("id") != F.col("first.row")).select("id"), row, "near_dropped")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    rows, view, row = keyed(docs)
    found = contamination(view, table(spark, sf_dir, "benchmark"), id_col="row")
    return kept(rows, found.filter("n_hit > 0").select("id"), row, "contaminated")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document, beside the document's own columns but for its text."""
    mixed = mixture(docs, carry=("lang", "n_chars")).taken()
    return mixed.select(F.col("id").alias("doc_id"), "lang", "source", "n_chars", "size", "source_size", "target", "taken")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
]

#: A trained classifier and pseudorandom permutations are beyond SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs all stages, each on the written result of the one before; what a stage needs in between is deleted after it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(keep=name):
            docs = written(stage(spark, docs, sf_dir), name)
        if before is not None:
            forget(before)
        before = docs
    return docs
