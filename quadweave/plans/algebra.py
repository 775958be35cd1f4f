"""The algebra that SPARQL text and structured queries are turned into."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Path:
    """op: seq, alt, inv, star, plus, opt, neg; args are IRIs or Paths."""

    op: str
    args: tuple


@dataclass
class Triple:
    s: Any
    p: Any
    o: Any


@dataclass
class BGP:
    triples: list[Triple]


@dataclass
class Group:
    """A group graph pattern: its elements in order; filters apply to the whole."""

    elements: list = field(default_factory=list)
    filters: list = field(default_factory=list)


@dataclass
class Optional:
    pattern: Group


@dataclass
class Union:
    branches: list[Group]


@dataclass
class Minus:
    pattern: Group


@dataclass
class Graph:
    name: Any
    pattern: Group


@dataclass
class Bind:
    expr: Any
    var: str


@dataclass
class Values:
    names: list[str]
    rows: list[list]


@dataclass
class TextSearch:
    """Text hits as solutions: variables for source, chunk, score, heading and content of chunks holding the phrase."""

    query: str
    variables: dict[str, str]
    options: dict = field(default_factory=dict)


@dataclass
class VectorSearch:
    query: list[float]
    variables: dict[str, str]
    options: dict = field(default_factory=dict)


@dataclass
class PathSearch:
    """Paths of bounded length as solutions, all unless `most` is given: variables for nodes and predicates (joined by blanks) and
    length."""

    start: str
    variables: dict[str, str]
    via: list[str] = field(default_factory=list)
    options: dict = field(default_factory=dict)


@dataclass
class Expr:
    """op: var, term, call, or, and, not, compare and arithmetic signs, in, notin, exists, notexists, agg."""

    op: str
    args: list = field(default_factory=list)
    name: str = ""
    distinct: bool = False


@dataclass
class Select:
    pattern: Group
    projection: list[tuple[str, Expr | None]] | None = None  # None: all visible variables
    distinct: bool = False
    group: list[tuple[Expr, str | None]] | None = None
    having: list[Expr] = field(default_factory=list)
    order: list[tuple[Expr, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    values: Values | None = None


@dataclass
class Query:
    form: str  # select, ask, construct, describe
    select: Select
    template: list[Triple] = field(default_factory=list)
    targets: list = field(default_factory=list)
    default_graphs: list[str] = field(default_factory=list)
    named_graphs: list[str] = field(default_factory=list)


@dataclass
class Update:
    """op: insert_data, delete_data, modify, clear, drop, create, add, copy, move; quads are (graph, Triple)."""

    op: str
    delete: list = field(default_factory=list)
    insert: list = field(default_factory=list)
    pattern: Group | None = None
    using: list[str] = field(default_factory=list)
    using_named: list[str] = field(default_factory=list)
    with_graph: str | None = None
    source: Any = None
    target: Any = None


def variables(node: Any) -> set[str]:
    """Names of the variables that occur in an expression or pattern."""
    from quadweave.terms import Variable

    if isinstance(node, Variable):
        return {node.name}
    if isinstance(node, Expr):
        out = {node.name} if node.op == "var" else set()
        return out.union(*(variables(a) for a in node.args)) if node.args else out
    if isinstance(node, Values):
        return set(node.names)
    if isinstance(node, Bind):
        return {node.var} | variables(node.expr)
    if isinstance(node, TextSearch | VectorSearch | PathSearch):
        return set(node.variables.values())
    if isinstance(node, Select):
        return {n for n, _ in node.projection} if node.projection else variables(node.pattern)
    if isinstance(node, list | tuple):
        return set().union(*(variables(a) for a in node))
    if isinstance(node, dict):
        return set()
    if hasattr(node, "__dataclass_fields__"):
        return set().union(*(variables(getattr(node, f)) for f in node.__dataclass_fields__))
    return set()
