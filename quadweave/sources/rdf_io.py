"""RDF documents in and results out."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadweave.errors import UnsupportedQuery
from quadweave.plans.parser import Parser
from quadweave.sources.datasets import QUADS
from quadweave.sources.rdfxml import parse_rdf_xml
from quadweave.terms import LANG_STRING, XSD, Blank, Iri, Literal, Variable, n_triples, make

# File extensions and the format of each.
FORMATS = {".nt": "ntriples", ".nq": "nquads", ".ttl": "turtle", ".trig": "trig", ".n3": "turtle", ".jsonld": "jsonld", ".rdf": "rdfxml", ".owl": "rdfxml", ".xml": "rdfxml"}

_TERM = r'(<[^>]*>|_:[\w.-]*\w|"(?:[^"\\]|\\.)*"(?:@[\w-]+|\^\^<[^>]*>)?)'
_LINE = rf"^\s*{_TERM}\s+(<[^>]*>)\s+{_TERM}\s*(<[^>]*>|_:[\w.-]*\w)?\s*\.\s*(?:#.*)?$"


def read_nquads(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """N-Quads and N-Triples files, split among tasks: one scan with patterns. Lines that are no statement are left out."""
    lines = spark.read.text(path).withColumn("file_", F.input_file_name())
    line = F.col("value")
    rows = lines.filter(line.rlike(_LINE)).select(*(F.regexp_extract(line, _LINE, i).alias(c) for i, c in ((1, "a"), (2, "b"), (3, "c"), (4, "d"))), "file_")

    def kind(c: str):
        return F.when(F.col(c).startswith("<"), "iri").when(F.col(c).startswith("_:"), "blank").otherwise("literal")

    def text(c: str):
        x = F.col(c)
        body = F.regexp_extract(x, r'^"((?:[^"\\]|\\.)*)"', 1)
        for escaped, plain in ((r"\t", "\t"), (r"\n", "\n"), (r"\r", "\r"), (r"\"", '"')):
            body = F.replace(F.replace(F.replace(body, F.lit("\\\\"), F.lit("\0")), F.lit(escaped), F.lit(plain)), F.lit("\0"), F.lit("\\\\"))
        body = F.replace(body, F.lit("\\\\"), F.lit("\\"))
        return F.when(x.startswith("<"), F.expr(f"substring({c}, 2, length({c}) - 2)")).when(x.startswith("_:"), F.expr(f"substring({c}, 3)")).otherwise(body)

    datatype = F.regexp_extract("c", r'"\^\^<([^>]*)>$', 1)
    lang = F.regexp_extract("c", r'"@([\w-]+)$', 1)
    graph = F.when(F.col("d") != "", text("d")).otherwise("")
    return rows.select(
        graph.alias("g"), kind("a").alias("sk"), text("a").alias("s"), text("b").alias("p"), kind("c").alias("ok"), text("c").alias("o"),
        F.when(~datatype.isin("", XSD + "string"), datatype).alias("od"), F.when(lang != "", F.lower(lang)).alias("ol"),
        (F.lit(source) if source else F.col("file_")).alias("source"), F.lit(None).cast("int").alias("line"),
    ).dropDuplicates(["g", "sk", "s", "p", "ok", "o", "od", "ol"])


def parse_turtle(text: str, base: str = "") -> Iterator[tuple]:
    """Quads (g, sk, s, p, ok, o, od, ol) of a Turtle or TriG document."""
    text = re.sub(r"^\s*@(prefix|base)\s+(.*?)\s*\.\s*$", lambda m: f"{m[1].upper()} {m[2]}", text, flags=re.MULTILINE)
    p = Parser(text, base)

    def row(g: str, t) -> tuple:
        def of(x):
            if isinstance(x, Variable):
                return "blank", x.name.removeprefix("_n"), None, None
            if isinstance(x, Iri):
                return "iri", x.value, None, None
            return ("blank", x.value, None, None) if isinstance(x, Blank) else ("literal", x.value, x.datatype, x.lang)

        s, o = of(t.s), of(t.o)
        if not isinstance(t.p, Iri) or s[0] == "literal":
            raise UnsupportedQuery("a statement needs an IRI for its predicate and no literal for its subject")
        return g, s[0], s[1], t.p.value, o[0], o[1], o[2], o[3]

    while p.peek()[0] != "end":
        p.prologue()
        if p.peek()[0] == "end":
            return
        if p.take("GRAPH") or p.is_iri() and p.peek(1)[1] == "{":
            g = p.iri()
            for _, t in p.quads():
                yield row(g, t)
        elif p.peek()[1] == "{":
            for _, t in p.quads():
                yield row("", t)
        else:
            for t in p.triples():
                yield row("", t)
            p.take(".")


def parse_jsonld(text: str, base: str = "") -> Iterator[tuple]:
    """Quads of expanded or compact JSON-LD with a context of terms and prefixes; remote contexts are an error."""
    n = 0

    def expand(name: str, context: dict) -> str:
        if name in context:
            x = context[name]
            name = x["@id"] if isinstance(x, dict) else x
        head, _, tail = name.partition(":")
        if head in context and not tail.startswith("//"):
            return expand(head, context) + tail
        return name if ":" in name else context.get("@vocab", base) + name

    def node(x: dict, context: dict, g: str, out: list) -> tuple:
        nonlocal n
        if isinstance(x.get("@context"), str):
            raise UnsupportedQuery("remote contexts are not read")
        context = context | (x.get("@context") or {})
        if "@id" in x:
            name = x["@id"]
            me = ("blank", name[2:]) if name.startswith("_:") else ("iri", expand(name, context) if ":" in name else urljoin(base, name))
        else:
            n += 1
            me = ("blank", f"j{n}")
        for k, v in x.items():
            if k == "@graph":
                for y in v:
                    node(y, context, me[1] if "@id" in x else g, out)
            elif k == "@type":
                for y in v if isinstance(v, list) else [v]:
                    out.append((g, *me, "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "iri", expand(y, context), None, None))
            elif not k.startswith("@"):
                for y in v if isinstance(v, list) else [v]:
                    value(me, expand(k, context), y, context.get(k), context, g, out)
        return me

    def value(me, p, y, term, context, g, out) -> None:
        kind = term.get("@type") if isinstance(term, dict) else None
        if isinstance(y, dict) and "@value" in y:
            v, d, lang = y["@value"], y.get("@type"), y.get("@language")
            value_row = literal_of(v, expand(d, context) if d else None, lang)
        elif isinstance(y, dict):
            value_row = (*node(y, context, g, out), None, None)
        elif kind == "@id":
            value_row = ("iri", expand(y, context), None, None)
        else:
            value_row = literal_of(y, expand(kind, context) if kind else None, None)
        out.append((g, *me, p, *value_row))

    def literal_of(v, d, lang) -> tuple:
        if isinstance(v, bool):
            return "literal", str(v).lower(), d or XSD + "boolean", None
        if isinstance(v, int | float):
            return "literal", str(v), d or XSD + ("integer" if isinstance(v, int) else "double"), None
        return "literal", str(v), None if d == XSD + "string" else d, lang.lower() if lang else None

    data = json.loads(text)
    out: list[tuple] = []
    for x in data if isinstance(data, list) else [data]:
        context = x.get("@context") or {}
        if "@graph" in x and "@id" not in x:
            for y in x["@graph"]:
                node(y, context, "", out)
        else:
            node(x, {}, "", out)
    yield from out


def read_documents(docs: DataFrame, source: str = "source", text: str = "text", format_: str = "turtle") -> DataFrame:
    """One document per row, parsed where the row is: turtle, trig, jsonld or rdfxml. Its graph is its source where it names
    none. Labels of blank nodes hold within a document only, so each gets its source's digest."""
    parse = {"turtle": parse_turtle, "trig": parse_turtle, "jsonld": parse_jsonld, "rdfxml": parse_rdf_xml}[format_]

    def run(frames):
        for frame in frames:
            rows = []
            for src, body in zip(frame["source"], frame["text"], strict=True):
                own = hashlib.blake2b((src or "").encode(), digest_size=8).hexdigest()
                for g, sk, s, p, ok, o, od, ol in parse(body or "", src or ""):
                    rows.append((g or src, sk, f"{s}_{own}" if sk == "blank" else s, p, ok, f"{o}_{own}" if ok == "blank" else o, od, ol, src, None))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in QUADS.split(", ")]).astype({"line": "Int32"})

    return docs.select(F.col(source).alias("source"), F.col(text).alias("text")).mapInPandas(run, QUADS).dropDuplicates(["g", "sk", "s", "p", "ok", "o", "od", "ol"])


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files of one format, known by the extension of path (a file, or a pattern such as dir/*.ttl); each is a source."""
    known = FORMATS.get(os.path.splitext(path)[1].lower())
    if known is None:
        raise UnsupportedQuery(f"no RDF format is known for {path}")
    if known in ("ntriples", "nquads"):
        return read_nquads(spark, path)
    return read_documents(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text")), format_=known)


def statements(triples: DataFrame) -> DataFrame:
    """Triples or quads as lines of N-Triples or N-Quads, ready for write.text."""
    s = make("", F.col("s"))
    s.k = F.col("sk")
    o = make("", F.col("o"), F.col("od"), F.col("ol"))
    o.k = F.col("ok")
    parts = [n_triples(s), F.concat(F.lit("<"), F.col("p"), F.lit(">")), n_triples(o)]
    graph = F.when(F.col("g") != "", F.concat(F.lit(" <"), F.col("g"), F.lit(">"))).otherwise("") if "g" in triples.columns else F.lit("")
    return triples.select(F.concat(F.concat_ws(" ", *parts), graph, F.lit(" .")).alias("value"))


def json_bindings(rel) -> DataFrame:
    """One SPARQL JSON binding object per solution; unbound variables are absent."""
    def one(n: str):
        v = rel.val(n)
        kind = F.when(v.k == "iri", "uri").when(v.k == "blank", "bnode").otherwise("literal")
        return F.when(v.v.isNotNull(), F.struct(kind.alias("type"), v.v.alias("value"), v.l.alias("xml:lang"), F.when(v.d != LANG_STRING, v.d).alias("datatype"))).alias(n)

    return rel.df.select(F.to_json(F.struct(*(one(n) for n in rel.vars))).alias("binding"))


def json_results(rel) -> str:
    """A whole SPARQL JSON result; for results that fit the driver."""
    rows = [json.loads(r[0]) for r in json_bindings(rel).collect()]
    return json.dumps({"head": {"vars": list(rel.vars)}, "results": {"bindings": rows}})


def rdf_xml(quads: DataFrame) -> DataFrame:
    """rdf:Description elements, one per subject and statement group; a named graph is an error."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
    checked = quads.withColumn("s", F.when(F.col("g") != "", F.raise_error(F.lit("RDF/XML holds the default graph only")).cast("string")).otherwise(F.col("s"))) if "g" in quads.columns else quads
    local = F.regexp_extract("p", r"([A-Za-z_][\w.-]*)$", 1)
    space = F.expr("substring(p, 1, length(p) - length(regexp_extract(p, '([A-Za-z_][\\\\w.-]*)$', 1)))")
    head = F.concat(F.lit("<x:"), local, F.lit(' xmlns:x="'), escape(space), F.lit('"'))
    attr = F.when(F.col("ol").isNotNull(), F.concat(F.lit(' xml:lang="'), F.col("ol"), F.lit('"'))).when(F.col("od").isNotNull(), F.concat(F.lit(' rdf:datatype="'), escape(F.col("od")), F.lit('"'))).otherwise("")
    element = F.when(F.col("ok") == "iri", F.concat(head, F.lit(' rdf:resource="'), escape(F.col("o")), F.lit('"/>'))).when(F.col("ok") == "blank", F.concat(head, F.lit(' rdf:nodeID="'), F.col("o"), F.lit('"/>'))).otherwise(F.concat(head, attr, F.lit(">"), escape(F.col("o")), F.lit("</x:"), local, F.lit(">")))
    about = F.when(F.col("sk") == "blank", F.concat(F.lit('rdf:nodeID="'), F.col("s"), F.lit('"'))).otherwise(F.concat(F.lit('rdf:about="'), escape(F.col("s")), F.lit('"')))
    rows = checked.select(about.alias("about"), element.alias("element")).groupBy("about").agg(F.array_join(F.array_sort(F.collect_list("element")), "").alias("body"))
    return rows.select(F.concat(F.lit("<rdf:Description "), F.col("about"), F.lit(">"), F.col("body"), F.lit("</rdf:Description>")).alias("value"))
