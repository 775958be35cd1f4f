"""RDF terms: constants of queries, and terms as groups of DataFrame columns.

A variable x of a solution is kept in flat columns, so that Catalyst prunes what a query does not use:
x__k kind (iri, blank, literal), x__v value, x__d datatype (null for plain strings), x__l language, x__n number (null unless
numeric), x__t instant (null unless an xsd:dateTime). Unbound is null in all of them. If x comes from an IRI template
(prefix + key), x__r holds the key, and joins between equal templates compare keys instead of strings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

XSD = "http://www.w3.org/2001/XMLSchema#"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
TYPE = RDF + "type"
LANG_STRING = RDF + "langString"
# The XSD datatypes that count as numeric.
NUMERIC = [
    "integer", "decimal", "float", "double", "nonPositiveInteger", "negativeInteger", "long", "int", "short", "byte",
    "nonNegativeInteger", "unsignedLong", "unsignedInt", "unsignedShort", "unsignedByte", "positiveInteger",
]
NUMERIC_IRIS = [XSD + n for n in NUMERIC]
INTEGER_IRIS = [XSD + n for n in NUMERIC if n not in ("decimal", "float", "double")]
FIELDS = ("k", "v", "d", "l", "n", "t")
TYPES = {"k": "string", "v": "string", "d": "string", "l": "string", "n": "double", "t": "timestamp", "r": "string"}


@dataclass(frozen=True)
class Iri:
    value: str


@dataclass(frozen=True)
class Blank:
    value: str


@dataclass(frozen=True)
class Literal:
    value: str
    datatype: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Variable:
    name: str


def literal(value: str, datatype: str | None = None, lang: str | None = None) -> Literal:
    return Literal(value, None if lang or datatype == XSD + "string" else datatype, lang.lower() if lang else None)


def integer(n: int) -> Literal:
    return Literal(str(n), XSD + "integer")


@dataclass
class Val:
    """A term-valued expression; b is set if it is a boolean whose truth is known as a Column."""

    k: Column
    v: Column
    d: Column
    l: Column  # noqa: E741
    n: Column
    t: Column
    b: Column | None = None
    r: Column | None = None
    template: str | None = None
    small: bool = False  # a constant number that a double holds exactly

    def columns(self, name: str) -> list[Column]:
        out = [getattr(self, f).cast(TYPES[f]).alias(f"{name}__{f}") for f in FIELDS]
        return out + ([self.r.alias(f"{name}__r")] if self.r is not None else [])


def null(kind: str) -> Column:
    return F.lit(None).cast(TYPES[kind])


def number_of(v: Column, d: Column) -> Column:
    """The value of a numeric literal; INF and NaN only where the datatype has them."""
    return F.when(d.isin(NUMERIC_IRIS) & (F.length(v) > 0), F.expr("1") * v.try_cast("double"))


def instant_of(v: Column, d: Column) -> Column:
    return F.when(d == XSD + "dateTime", F.try_to_timestamp(v))


def make(k, v: Column, d=None, l=None, n: Column | None = None, t: Column | None = None) -> Val:  # noqa: E741
    d = F.lit(d) if not isinstance(d, Column) else d
    l = F.lit(l) if not isinstance(l, Column) else l  # noqa: E741
    k = F.when(v.isNotNull(), F.lit(k)) if isinstance(k, str) else k
    return Val(k, v, d.cast("string"), l.cast("string"), null("n") if n is None else n, null("t") if t is None else t)


def constant(term) -> Val:
    if isinstance(term, Iri):
        return make("iri", F.lit(term.value))
    if isinstance(term, Blank):
        return make("blank", F.lit(term.value))
    n, t = None, None
    if term.datatype in NUMERIC_IRIS:
        try:
            n = F.lit(float(term.value))
        except ValueError:
            n = None
    if term.datatype == XSD + "dateTime":
        t = F.try_to_timestamp(F.lit(term.value))
    out = make("literal", F.lit(term.value), term.datatype, term.lang, n, t)
    out.small = n is not None and abs(float(term.value)) < EXACT
    if term.datatype == XSD + "boolean" and term.value in ("true", "false", "1", "0"):
        out.b = F.lit(term.value in ("true", "1"))
    return out


def string(v: Column) -> Val:
    return make("literal", v)


def boolean(b: Column) -> Val:
    out = make("literal", F.when(b, "true").when(~b, "false"), F.when(b.isNotNull(), F.lit(XSD + "boolean")))
    out.b = b
    return out


#: From here on doubles no longer tell neighbouring integers apart.
EXACT = float(2**53)


def digits(v: Val) -> Column:
    """The value of an integer literal with all its digits (38 at most); null of anything else."""
    return F.when(v.d.isin(INTEGER_IRIS), v.v.try_cast("decimal(38,0)"))


def number(n: Column, d, exact: Column | None = None) -> Val:
    """A computed number of datatype d; integers are written without a fraction, from exact where that is not null."""
    d = d if isinstance(d, Column) else F.lit(XSD + d)
    whole = d.isin(INTEGER_IRIS) | ((d == XSD + "decimal") & (n == F.floor(n)) & (F.abs(n) < 1e15))
    v = F.when(whole, n.cast("decimal(38,0)").cast("string")).otherwise(n.cast("string"))
    v = v if exact is None else F.coalesce(exact.cast("string"), v)
    return make("literal", v, F.when(n.isNotNull(), d), None, n)


def from_columns(name: str, template: str | None = None) -> Val:
    c = {f: F.col(f"`{name}__{f}`") for f in FIELDS}
    return Val(**c, r=F.col(f"`{name}__r`") if template else None, template=template)


def same(a: Val, b: Val) -> Column:
    """Term identity; null if either is unbound. Equal templates compare their keys."""
    if a.template and a.template == b.template:
        return a.r == b.r
    blank = F.lit("")
    return (a.v == b.v) & (a.k == b.k) & (F.coalesce(a.d, blank) == F.coalesce(b.d, blank)) & (F.coalesce(a.l, blank) == F.coalesce(b.l, blank))


def identity(v: Val) -> Column:
    """One struct that is equal for equal terms, and null if unbound."""
    return F.when(v.v.isNotNull(), F.struct(v.k.alias("k"), v.v.alias("v"), F.coalesce(v.d, F.lit("")).alias("d"), F.coalesce(v.l, F.lit("")).alias("l")))


def order_keys(v: Val, descending: bool = False) -> list[Column]:
    """Unbound first, then blank nodes, IRIs, literals; numbers and instants by value, NaN after all other numbers."""
    rank = F.when(v.v.isNull(), 0).when(v.k == "blank", 1).when(v.k == "iri", 2).otherwise(3)
    value = F.coalesce(v.n, v.t.cast("double"))
    keys = [rank, value.isNull(), value, v.v, v.l, v.d]
    return [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in keys]


def n_triples(v: Val) -> Column:
    """The term as N-Triples text."""
    text = F.replace(F.replace(F.replace(F.replace(v.v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))
    tail = F.when(v.l.isNotNull(), F.concat(F.lit("@"), v.l)).when(v.d.isNotNull(), F.concat(F.lit("^^<"), v.d, F.lit(">"))).otherwise("")
    return F.when(v.k == "iri", F.concat(F.lit("<"), v.v, F.lit(">"))).when(v.k == "blank", F.concat(F.lit("_:"), v.v)).otherwise(F.concat(F.lit('"'), text, F.lit('"'), tail))
