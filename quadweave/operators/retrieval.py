"""What is indexed for retrieval, and listings of what is: cards of entities and folders, points of markdown texts, budgets."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadweave.operators.search import normalized, tokens
from quadweave.terms import LANG_STRING, XSD

# Local names of predicates (lower case, without - _ and blanks) by what their text is for.
SEARCHABLE = ["abstract", "acceptance", "altlabel", "articlebody", "body", "comment", "content", "description", "label", "name", "note", "preflabel", "summary", "text", "title"]
HEADINGS = ["altlabel", "label", "name", "preflabel", "title"]
STRUCTURED = ["created", "createdat", "datecreated", "datemodified", "modified", "modifiedat", "order", "position", "priority", "rank", "score", "status"]
RELATIONS = ["author", "creator", "editor", "follows", "haspart", "ispartof", "knows", "member", "mentions", "owner", "parent", "relatedto", "replyto"]
SENSITIVE_PARTS = ["apikey", "accesskey", "authorization", "credential", "password", "privatekey", "proxy", "secret", "token"]
SYSTEM_PREFIXES = ["http://www.w3.org/ns/auth/acl#", "http://www.w3.org/ns/solid/acp#", "http://www.w3.org/ns/solid/terms#"]

#: Bytes of a retrieval point at most.
POINT_BYTES = 8192
_KEY = 24


def key_of(*parts: Column | str) -> Column:
    """24 hexadecimal digits of the SHA-256 of parts with a zero byte between them."""
    texts = [F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]
    return F.substring(F.sha2(F.concat_ws("\0", *texts).cast("binary"), 256), 1, _KEY)


def term_hash(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    """The identity of a term as a SHA-256."""
    empty = F.lit("")
    return F.sha2(F.concat_ws("\0", kind, value, F.coalesce(datatype, empty), F.coalesce(lang, empty)).cast("binary"), 256)


def local_name(predicate: Column) -> Column:
    return F.regexp_extract(predicate, r"([^#/:]*)$", 1)


def label_of(predicate: Column) -> Column:
    """A predicate's local name as words."""
    spaced = F.regexp_replace(F.regexp_replace(local_name(predicate), "[_-]+", " "), "([a-z0-9])([A-Z])", "$1 $2")
    return F.when(F.trim(spaced) == "", "text").otherwise(F.trim(spaced))


def role_of(predicate: Column, system: tuple[str, ...] = tuple(SYSTEM_PREFIXES)) -> Column:
    """system, sensitiveText, searchableText, structured, relation or displayOnlyText."""
    p = F.lower(F.trim(predicate))
    name = F.regexp_replace(local_name(p), r"[-_\s]", "")
    hidden = p == ""
    for prefix in system:
        hidden |= p.startswith(prefix)
    secret = F.lit(False)
    for part in SENSITIVE_PARTS:
        secret |= F.contains(name, F.lit(part))
    return F.when(hidden, "system").when(secret, "sensitiveText").when(name.isin(SEARCHABLE), "searchableText").when(name.isin(STRUCTURED), "structured").when(name.isin(RELATIONS), "relation").otherwise("displayOnlyText")


def entity_cards(quads: DataFrame, max_field_bytes: int | None = None) -> DataFrame:
    """Cards of the subjects of quads (with their source): source, entity, kind, chunk_key, ordinal, heading, content.

    Searchable plain and language-tagged literals make one entity-card a subject, a line each, by predicate and value; each
    one of more than max_field_bytes is a field-chunk of its own, after its subject's card. The heading is the first of the
    card's fields that names something."""
    p = F.col("p")
    text = quads.filter((F.col("ok") == "literal") & (F.col("od").isNull() | (F.col("od") == XSD + "string") | (F.col("od") == LANG_STRING) | F.col("ol").isNotNull()) & (role_of(p) == "searchableText"))
    long = F.octet_length("o") > max_field_bytes if max_field_bytes is not None else F.lit(False)
    naming = F.regexp_replace(F.lower(local_name(p)), r"[-_\s]", "").isin(HEADINGS)
    rows = text.select("source", F.col("s").alias("entity"), "p", "o", F.concat(label_of(p), F.lit(": "), F.col("o")).alias("line"), long.alias("long"), naming.alias("naming"))
    rank = F.struct("p", "o", "line")
    cards = rows.groupBy("source", "entity").agg(
        F.array_sort(F.collect_list(F.when(~F.col("long"), rank))).alias("short"), F.array_sort(F.collect_list(F.when(F.col("long"), rank))).alias("fields"),
        F.min(F.when(~F.col("long") & F.col("naming"), F.struct("p", "o"))).alias("head"))
    card = F.when(F.size("short") > 0, F.array(F.struct(F.lit("entity-card").alias("kind"), key_of(F.col("source"), "rdf-entity", F.col("entity")).alias("chunk_key"), F.array_join(F.transform("short", lambda x: x["line"]), "\n").alias("content"))))
    field = F.transform("fields", lambda x: F.struct(F.lit("field-chunk").alias("kind"), key_of(F.col("source"), "rdf-field", F.col("entity"), x["p"], x["o"]).alias("chunk_key"), x["line"].alias("content")))
    out = cards.select("source", "entity", F.col("head.o").alias("heading"), F.posexplode(F.concat(F.coalesce(card, F.filter(field, lambda _: F.lit(False))), field)).alias("n", "x"))
    ordinal = F.row_number().over(Window.partitionBy("source").orderBy("entity", "n")) - 1
    return out.select("source", "entity", "x.kind", "x.chunk_key", ordinal.alias("ordinal"), "heading", "x.content")


def folder_cards(folders: DataFrame, source: str = "source", text: str = "text") -> DataFrame:
    """One chunk per folder (a source that ends in /) with text: its heading is the last part of its path."""
    path = F.filter(F.split(F.regexp_replace(F.col(source), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*", ""), "/"), lambda x: x != "")
    content = F.regexp_replace(F.col(text), r"^\s+|\s+$", "")
    rows = folders.filter(F.col(source).endswith("/")).select(F.col(source).alias("source"), path.alias("path"), content.alias("content"), F.length(text).alias("end_offset")).filter("content != ''")
    return rows.select("source", F.lit("folder-card").alias("kind"), key_of(F.col("source"), "0").alias("chunk_key"), F.lit(0).alias("ordinal"), F.element_at("path", -1).alias("heading"), "path", "content", F.lit(0).alias("start_offset"), "end_offset")


_FENCE, _HEADING = re.compile(r" {0,3}(`{3,}|~{3,})"), re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_ITEM, _RULE, _UNDER = re.compile(r"\s*(?:[-*+]|\d{1,9}[.)])[ \t]+"), re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$"), re.compile(r" {0,3}(=+|-+)[ \t]*$")


def blocks(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, first, last) of the blocks of a markdown text, in characters: heading1 to heading6, paragraph, item, code, rule."""
    at, open_, fence = 0, None, None  # open_: kind, first, last of the block that may go on
    for line in text.splitlines(keepends=True):
        first, body = at, line.rstrip("\r\n")
        at += len(line)
        last = first + len(body)
        if fence:
            if body.strip().startswith(fence) and not body.strip().strip(fence[0]):
                yield "code", open_[1], last
                open_ = fence = None
            continue
        if m := _FENCE.match(body):
            if open_:
                yield open_
            open_, fence = ("code", first, last), m[1]
        elif not body.strip():
            if open_:
                yield open_
            open_ = None
        elif open_ and open_[0] == "paragraph" and (m := _UNDER.match(body)):
            yield f"heading{1 if m[1][0] == '=' else 2}", open_[1], last
            open_ = None
        elif (m := _HEADING.match(body)) or _RULE.match(body):
            if open_:
                yield open_
            yield (f"heading{len(m[1])}" if m else "rule"), first, last
            open_ = None
        elif _ITEM.match(body):
            if open_:
                yield open_
            open_ = ("item", first, last)
        else:
            open_ = (open_[0], open_[1], last) if open_ else ("paragraph", first, last)
    if open_:
        yield open_[0], open_[1], len(text) if fence else open_[2]


def within_bytes(text: str, most: int) -> Iterator[tuple[int, int]]:
    """Character ranges of pieces of at most `most` bytes of UTF-8; a piece ends after a blank where one is in its second half."""
    first = size = 0
    for i, c in enumerate(text):
        n = len(c.encode("utf-8", "surrogatepass"))
        while size + n > most and i > first:
            blank = max(text.rfind(" ", first, i), text.rfind("\n", first, i)) + 1
            end = blank if blank > (first + i) // 2 else i
            yield first, end
            size = len(text[end:i].encode("utf-8", "surrogatepass"))
            first = end
        size += n
    if first < len(text):
        yield first, len(text)


def points_of(source: str, text: str, most: int = POINT_BYTES) -> Iterator[tuple]:
    """Retrieval points of one markdown text, in order; see markdown_points."""
    stack: list[tuple[int, str]] = []
    n = leaf = place = 0
    for kind, first, last in blocks(text):
        body = text[first:last]
        if kind.startswith("heading"):
            level = int(kind[7])
            title = (m[2] or "") if (m := _HEADING.match(body)) else body.rsplit("\n", 1)[0]
            stack = [x for x in stack if x[0] < level]
            if title.strip():
                stack.append((level, title.strip()))
            place = 0
            continue
        place += 1
        if kind == "rule":
            continue
        inner = body.split("\n", 1)[1].rsplit("\n", 1)[0] if kind == "code" and body.count("\n") > 1 else _ITEM.sub("", body, count=1) if kind == "item" else body
        start = first + (body.find(inner) if inner else 0)
        start += len(inner) - len(inner.lstrip())
        inner = inner.strip()
        if not inner:
            continue
        path = [x[1] for x in stack]
        where = "/".join([*path, f"{kind}:{place - 1}", f"leaf:{leaf}"])
        leaf += 1
        for part, (a, b) in enumerate(within_bytes(inner, most)):
            piece = inner[a:b]
            raw = "\0".join((source, where, str(part), piece)).encode("utf-8", "surrogatepass")
            start_byte = len(text[: start + a].encode("utf-8", "surrogatepass"))
            yield n, part, where, stack[-1][0] if stack else 0, path[-1] if path else None, path, piece, start + a, start + b, start_byte, start_byte + len(piece.encode("utf-8", "surrogatepass")), hashlib.sha256(raw).hexdigest()[:_KEY]
            n += 1


POINT = "source string, ordinal int, part int, structural_path string, level int, heading string, path array<string>, content string, start_offset int, end_offset int, start_byte int, end_byte int, chunk_key string"


def markdown_points(df: DataFrame, source: str, text: str, most: int = POINT_BYTES) -> DataFrame:
    """Retrieval points of markdown texts: paragraphs, list items and code blocks under their headings, in pieces of at most
    `most` bytes. A point's key comes from its source, its place and its text, so it stays the same while these do."""
    names = [c.split()[0] for c in POINT.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(s, *p) for s, t in zip(frame["source"], frame["text"], strict=True) for p in points_of(s or "", t or "", most)]
            yield pd.DataFrame(rows, columns=names)

    return df.select(F.col(source).cast("string").alias("source"), F.col(text).alias("text")).mapInPandas(run, POINT)


def extract_json(text: Column) -> Column:
    """String leaves of JSON-LD under keys that do not begin with @, longer than three characters and no links, one a line;
    what is no JSON stays as it is."""

    def leaves(x) -> Iterator[str]:
        if isinstance(x, str):
            if len(x) > 3 and not x.startswith("http"):
                yield x
        elif isinstance(x, list):
            for y in x:
                yield from leaves(y)
        elif isinstance(x, dict):
            for k, y in x.items():
                if not k.startswith("@"):
                    yield from leaves(y)

    def one(t: str | None) -> str | None:
        try:
            return t if t is None else "\n".join(leaves(json.loads(t)))
        except ValueError:
            return t

    @F.pandas_udf("string")
    def extract(s: pd.Series) -> pd.Series:
        return s.map(one)

    return extract(text)


@dataclass
class TextIndex:
    """chunks and postings of what was indexed, and a status row per source."""

    chunks: DataFrame
    postings: DataFrame
    status: DataFrame


def index_text(texts: DataFrame, chunks: DataFrame, max_source_bytes: int | None = None, max_chunks: int | None = None) -> TextIndex:
    """Postings of chunks (source, ordinal, content) of texts (source, text). A source of more than max_source_bytes is
    skipped; of more than max_chunks chunks, the first ones are taken. status: source, state (indexed, skipped or capped),
    reason, bytes, chunks (taken)."""
    size = F.octet_length(F.coalesce("text", F.lit("")))
    sources = texts.select("source", size.alias("bytes"), (size > max_source_bytes if max_source_bytes is not None else F.lit(False)).alias("skipped"))
    own = chunks.join(sources.filter("not skipped").select("source"), "source", "left_semi")
    taken = own.filter(F.col("ordinal") < max_chunks) if max_chunks is not None else own
    counts = own.groupBy("source").agg(F.count("*").alias("made"), F.count(F.when(F.col("ordinal") < max_chunks if max_chunks is not None else F.lit(True), 1)).alias("chunks"))
    capped = F.col("made") > F.col("chunks")
    status = sources.join(counts, "source", "left").select(
        "source", F.when(F.col("skipped"), "skipped").when(capped, "capped").otherwise("indexed").alias("state"),
        F.when(F.col("skipped"), "maxSourceBytes").when(capped, "maxChunksPerSource").alias("reason"), "bytes", F.coalesce("chunks", F.lit(0)).alias("chunks"))
    posted = taken.select("source", "ordinal", F.explode(tokens(normalized(F.col("content")))).alias("term")).groupBy("source", "ordinal", "term").agg(F.count("*").alias("occurrences"))
    return TextIndex(taken, posted, status)


def estimate(hits: DataFrame) -> DataFrame:
    """How many hits and sources a search has, after its filters and window."""
    return hits.agg(F.count("*").alias("hits"), F.count_distinct("source").alias("sources"))


def ids_after(rows: DataFrame, key: str, cursor=None, limit: int = 100) -> DataFrame:
    """A page of keys after a cursor."""
    after = rows if cursor is None else rows.filter(F.col(key) > F.lit(cursor))
    return after.select(key).distinct().orderBy(key).limit(limit)


def summaries(vectors: DataFrame, kind: str = "summary", model: str | None = None, source_prefix: str = "") -> DataFrame:
    """Listing of the vectors of one kind of input (column input_kind), by source and ordinal."""
    df = vectors.filter(F.col("input_kind") == kind)
    df = df if model is None else df.filter(F.col("model") == model)
    return (df.filter(F.col("source").startswith(source_prefix)) if source_prefix else df).orderBy("source", "ordinal")


def candidate_budget(limit: int, offset: int = 0) -> int:
    """Candidates that a search may pass on where an approximate page is asked for: 32 a row of it, 256 to 4096."""
    return max(256, min(4096, 32 * (limit + offset)))


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """A page of rows, each with the number of all rows as `total`. The rows are counted apart, not in one window."""
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(F.broadcast(rows.agg(F.count("*").alias("total"))))


def usage(deltas: DataFrame, scopes: list[str], amounts: list[str]) -> DataFrame:
    """Counters per scope (one row per scope column and its value): sums of amounts, never below zero."""
    named = F.explode(F.array(*(F.struct(F.lit(s).alias("scope"), F.col(s).cast("string").alias("id")) for s in scopes)))
    rows = deltas.select(named.alias("x"), *amounts).filter("x.id is not null")
    return rows.groupBy("x.scope", "x.id").agg(*(F.greatest(F.sum(F.coalesce(a, F.lit(0))), F.lit(0)).alias(a) for a in amounts))
