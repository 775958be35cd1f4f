"""Full-text and vector retrieval, and how their hits become terms that join with graph patterns."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from functools import cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.terms import Val, XSD, make, number, string

_CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}"


@cache
def _unchanged() -> str:
    """A pattern of texts made of the longest runs of characters that leave a text as it is under NFKC: such that are their
    own form and join nothing before them. Runs of Latin letters come first, as most characters are there."""

    def stays(c: int) -> bool:
        return not (0xD800 <= c < 0xE000 or 0x1161 <= c <= 0x11C2 or unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c))

    runs, first = [], 0
    for c in range(0x10000):
        if not stays(c):
            runs.append((first, c - 1))
            first = c + 1
    latin = [r for r in runs if r[0] < 0x250 and r[1] >= r[0]]
    others = sorted(sorted((r for r in runs if r[0] >= 0x250), key=lambda r: r[0] - r[1])[:24])
    return r"\A[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in latin + others) + r"]*+\z"


def unified(text: Column) -> Column:
    """Compatibility forms unified (NFKC). Only texts that it may change go through Python, in Arrow batches."""

    @F.pandas_udf("string")
    def unify(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    ascii_only = F.octet_length(text) == F.length(text)  # far cheaper to see, and true of most texts
    return F.coalesce(unify(F.when(~(ascii_only | text.rlike(_unchanged())), text)), text)


def normalized(text: Column) -> Column:
    """Compatibility forms unified, lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(unified(text)), r"\s+", " "))


def tokens(norm: Column) -> Column:
    """Runs of letters, marks and digits; a run of CJK characters becomes its pairs, a single one stays."""
    runs = F.regexp_extract_all(norm, F.lit(rf"([{_CJK}]+|[\p{{L}}\p{{M}}\p{{N}}&&[^{_CJK}]]+)"), F.lit(1))
    pairs = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substr(t, i, F.lit(2)))
    split = lambda t: F.when(t.rlike(f"^[{_CJK}]") & (F.length(t) > 1), pairs(t)).otherwise(F.array(t))
    return F.flatten(F.transform(runs, split))


def chunk_plain(df: DataFrame, source: str, text: str) -> DataFrame:
    """Paragraphs of plain text: source, ordinal, content, start_offset, end_offset, chunk_key. Blank lines part them; a
    text of one paragraph is parted by lines. Contents are trimmed and empty ones left out. Offsets count characters."""
    t = F.coalesce(F.col(text), F.lit(""))
    blank = F.filter(F.split(t, r"\n[ \t\r]*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    lines = F.filter(F.split(t, r"\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")
    parts = F.transform(F.when(F.size(blank) > 1, blank).otherwise(lines), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<struct<content:string,start:int>>").alias("out"))

    def place(acc: Column, x: Column) -> Column:
        at = F.call_function("locate", x, t, acc["at"])
        return F.struct((at + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("content"), (at - 1).alias("start")))).alias("out"))

    rows = df.select(F.col(source).alias("source"), F.posexplode(F.aggregate(parts, start, place)["out"]).alias("ordinal", "c"))
    key = F.substring(F.sha2(F.concat(F.col("source").cast("string"), F.lit("\0"), F.col("ordinal").cast("string")).cast("binary"), 256), 1, 24)
    return rows.select("source", "ordinal", F.col("c.content").alias("content"), F.col("c.start").alias("start_offset"), (F.col("c.start") + F.length("c.content")).alias("end_offset"), key.alias("chunk_key"))


def chunk_headings(df: DataFrame, source: str, text: str) -> DataFrame:
    """Sections of markdown by headings of levels 1 to 6, code fences respected: source, ordinal, level, heading, path (the
    headings above and its own), content. Text before the first heading has level 0."""

    def run(frames):
        for frame in frames:
            out = []
            for src, body in zip(frame["source"], frame["text"], strict=True):
                stack, fence, sections = [], "", [(0, None, [], [])]
                for line in (body or "").split("\n"):
                    mark = line.lstrip()[:3]
                    if mark in ("```", "~~~") and (not fence or mark == fence):
                        fence = "" if fence else mark
                    level = len(line) - len(line.lstrip("#"))
                    if not fence and 1 <= level <= 6 and line[level : level + 1] in (" ", "\t"):
                        title = line[level:].strip().rstrip("#").strip()
                        stack = [x for x in stack if x[0] < level] + [(level, title)]
                        sections.append((level, title, [x[1] for x in stack], []))
                    else:
                        sections[-1][3].append(line)
                n = 0
                for level, title, path, lines in sections:
                    content = "\n".join(lines).strip()
                    if content or title is not None:
                        out.append((src, n, level, title, path, content))
                        n += 1
            yield pd.DataFrame(out, columns=["source", "ordinal", "level", "heading", "path", "content"])

    rows = df.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "source string, ordinal int, level int, heading string, path array<string>, content string")


def extract_html(html: Column) -> Column:
    """The text of HTML: script and style dropped, tags and white space become single blanks."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?s)<[^>]*>", " "), r"\s+", " "))


def extract_turtle(text: Column) -> Column:
    """Quoted literals of Turtle that are longer than three characters and no IRIs, joined by blanks."""
    found = F.regexp_extract_all(text, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))
    return F.array_join(F.filter(found, lambda x: (F.length(x) > 3) & ~x.rlike(r"^(https?:|urn:)")), " ")


def postings(chunks: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """(*key, term, occurrences)"""
    return chunks.select(*key, F.explode(tokens(normalized(F.col(content)))).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("occurrences"))


def document_frequency(posted: DataFrame, source: str, chunk: Sequence[str]) -> DataFrame:
    """term, sources, chunks, occurrences"""
    return posted.groupBy("term").agg(F.count_distinct(source).alias("sources"), F.count_distinct(F.struct(*chunk)).alias("chunks"), F.sum("occurrences").alias("occurrences"))


def occurrences(norm: Column, phrase: str) -> Column:
    """How often phrase occurs, without overlaps."""
    return ((F.length(norm) - F.length(F.replace(norm, F.lit(phrase), F.lit("")))) / len(phrase)).cast("int")


def source_condition(source: Column, options: dict) -> Column:
    """Exact sources, prefix, allowed, denied and denied prefixes; an empty allow-list admits nothing."""
    c = F.lit(True)
    for name in ("sources", "allowed_sources"):
        if options.get(name) is not None:
            c &= source.isin(list(options[name])) if options[name] else F.lit(False)
    if options.get("source_prefix"):
        c &= source.startswith(options["source_prefix"])
    if options.get("denied_sources"):
        c &= ~source.isin(list(options["denied_sources"]))
    for p in options.get("denied_prefixes", ()):
        c &= ~source.startswith(p)
    return c


def text_search(chunks: DataFrame, query: str, entities: Sequence[str] = (), per_source: int | None = None, limit: int | None = None, offset: int = 0, descending: bool = True, **options) -> DataFrame:
    """Chunks (source, ordinal, content[, heading, entities]) whose normalized text contains the normalized phrase, with
    score = its occurrences, and 100 more if the heading contains it. Given entities must all be mentioned; with an empty
    phrase the score is then 1. Best first, then source and ordinal; per_source keeps the best few of each source."""
    phrase = " ".join(unicodedata.normalize("NFKC", query).lower().split())
    df = chunks.filter(source_condition(F.col("source"), options))
    if entities:
        df = df.filter(F.size(F.array_except(F.array(*map(F.lit, entities)), F.col("entities"))) == 0)
    if phrase:
        norm = normalized(F.col("content"))
        head = normalized(F.col("heading")) if "heading" in chunks.columns else F.lit(None).cast("string")
        boost = F.when(F.coalesce(F.contains(head, F.lit(phrase)), F.lit(False)), 100).otherwise(0)
        df = df.withColumn("score", occurrences(norm, phrase) + boost).filter(F.contains(norm, F.lit(phrase)) | (boost > 0))
    else:
        df = df.withColumn("score", F.lit(1)) if entities else df.filter(F.lit(False)).withColumn("score", F.lit(0))
    order = [F.desc("score") if descending else F.asc("score"), "source", "ordinal"]
    if per_source:
        df = df.withColumn("rank_", F.row_number().over(Window.partitionBy("source").orderBy(*order))).filter(F.col("rank_") <= per_source).drop("rank_")
    if limit is not None or offset:
        df = df.orderBy(*order).offset(offset)
        df = df.limit(limit) if limit is not None else df
    return df


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, query: Sequence[float], metric: str = "cosine", threshold: float | None = None, limit: int | None = None, offset: int = 0, exclude: DataFrame | None = None, key: str = "vec_id", embedding: str = "embedding", where: dict | None = None) -> DataFrame:
    """Exact nearest neighbours with score and distance: cosine (score dot / (|q| |c|), distance 1 - score; zero vectors
    left out), dot (distance -dot), euclidean (score -distance). Only vectors of the query's length count. threshold is the
    least score; for euclidean it must not be above 0. where: column = value for provider, model and the like."""
    q = F.array(*(F.lit(float(x)) for x in query))
    size = sum(float(x) ** 2 for x in query) ** 0.5
    df = vectors.filter(F.size(embedding) == len(query))
    for c, v in (where or {}).items():
        df = df.filter(F.col(c) == v)
    e = F.col(embedding)
    if metric == "euclidean":
        square = F.aggregate(F.zip_with(e, q, lambda x, y: F.pow(x.cast("double") - y, F.lit(2.0))), F.lit(0.0), lambda s, x: s + x)
        df = df.withColumn("distance", F.when(square < 1e-12, 0.0).otherwise(F.sqrt(square))).withColumn("score", 0.0 - F.col("distance"))
    else:
        df = df.withColumn("score", dot(e, q))
        if metric == "cosine":
            length = F.sqrt(dot(e, e))
            df = df.filter((length > 0) & F.lit(size > 0)).withColumn("score", F.col("score") / (length * size))
        df = df.withColumn("distance", (1 - F.col("score")) if metric == "cosine" else -F.col("score"))
    if threshold is not None:
        finite = threshold == threshold and abs(threshold) != float("inf")
        df = df.filter(F.col("score") >= threshold) if finite and (metric != "euclidean" or threshold <= 0) else df.filter(F.lit(threshold == float("-inf")))
    if exclude is not None:
        df = df.join(exclude, key, "left_anti")
    if limit is not None or offset:
        df = df.orderBy(F.desc("score"), key).offset(offset)
        df = df.limit(limit) if limit is not None else df
    return df


def model_search(vectors: DataFrame, query: Sequence[float], limit: int = 10, threshold: float = 0.0, exclude: DataFrame | None = None, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Per-model search over unit vectors: (key, score) with score = 1 - L2**2 / 2, clamped to 0..1."""
    hits = vector_search(vectors, query, "euclidean", exclude=exclude, key=key, embedding=embedding)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.pow("distance", F.lit(2.0)) / 2))
    return hits.select(key, score.alias("score")).filter(F.col("score") >= threshold).orderBy(F.desc("score"), key).limit(limit)


def upsert_vectors(vectors: DataFrame, new: DataFrame, key: str = "vec_id") -> DataFrame:
    return vectors.join(new, key, "left_anti").unionByName(new)


def model_distribution(vectors: DataFrame, by: Sequence[str], embedding: str = "embedding") -> DataFrame:
    """Per model identity: number of vectors, dimensions, and least, greatest and mean length."""
    length = F.sqrt(dot(F.col(embedding), F.col(embedding)))
    return vectors.groupBy(*by, F.size(embedding).alias("dimensions")).agg(F.count("*").alias("vectors"), F.min(length).alias("min_magnitude"), F.max(length).alias("max_magnitude"), F.avg(length).alias("avg_magnitude"))


def embedding_inputs(chunks: DataFrame) -> DataFrame:
    """Two inputs per chunk (source, ordinal, path, content): locator, the headings above it, and semantic, its content;
    with the SHA-256 of each. Empty inputs are left out."""
    locator = F.concat(F.lit("Path: "), F.col("source"), F.when(F.size("path") > 0, F.concat(F.lit("\nHeading: "), F.array_join("path", " / "))).otherwise(""))
    inputs = F.array(F.struct(F.lit("locator").alias("kind"), locator.alias("input")), F.struct(F.lit("semantic").alias("kind"), F.trim("content").alias("input")))
    rows = chunks.select("source", "ordinal", F.explode(inputs).alias("x")).select("source", "ordinal", "x.kind", "x.input").filter("input != ''")
    return rows.withColumn("input_hash", F.sha2(F.col("input").cast("binary"), 256))


def fuse(text_hits: DataFrame, vector_hits: DataFrame, on: Sequence[str], weights: tuple[float, float] = (0.55, 0.45), limit: int | None = 8) -> DataFrame:
    """Weighted fusion of hits with text_score and vector_score, best first, ties by key. Filters belong before it."""
    both = text_hits.join(vector_hits, list(on)).withColumn("rank_score", F.col("text_score") * weights[0] + F.col("vector_score") * weights[1])
    both = both.orderBy(F.desc("rank_score"), *on)
    return both.limit(limit) if limit is not None else both


def run_context(chunks: DataFrame, phrase: str, vectors: DataFrame | None = None, query: Sequence[float] | None = None, limit: int = 8, **options) -> DataFrame:
    """Composed retrieval: text hits; with a query vector, hits of the same source too; weighted score; scope first."""
    hits = text_search(chunks, phrase, **options).withColumnRenamed("score", "text_score")
    if vectors is None or query is None:
        return hits.withColumn("rank_score", F.col("text_score") * 0.55).orderBy(F.desc("rank_score"), "source", "ordinal").limit(limit)
    near = vector_search(vectors.filter(source_condition(F.col("source"), options)), query, key="source").groupBy("source").agg(F.max("score").alias("vector_score"))
    return fuse(hits, near, ["source"], limit=limit)


def text_hits(chunks: DataFrame, e) -> DataFrame:
    return text_search(chunks, e.query, **e.options)


def vector_hits(vectors: DataFrame, e) -> DataFrame:
    return vector_search(vectors, e.query, **e.options)


def as_terms(hits: DataFrame, variables: dict[str, str]) -> dict[str, Val]:
    """Hit columns bound to variables: source and chunk as IRIs, scores as decimals, ordinals and offsets as integers, other
    columns as plain literals."""
    out = {}
    for column, name in variables.items():
        if column == "source":
            out[name] = make(F.lit("iri"), F.col("source").cast("string"))
        elif column == "chunk":
            out[name] = make(F.lit("iri"), F.concat(F.col("source").cast("string"), F.lit("#chunk-"), F.col("chunk_key")))
        elif column in ("score", "distance"):
            out[name] = number(F.col(column).cast("double"), "decimal")
        elif column in ("ordinal", "start_offset", "end_offset", "level", "length", "vec_id"):
            out[name] = number(F.col(column).cast("double"), "integer")
        elif column == "path":
            out[name] = string(F.array_join("path", " / "))
        else:
            out[name] = string(F.col(column).cast("string"))
    return out


__all__ = ["XSD"]
