"""A recursive-descent parser of SPARQL 1.1 queries and updates."""

from __future__ import annotations

import re
from urllib.parse import urljoin

from quadweave.errors import DisabledFeature, SparqlSyntaxError, UnsupportedQuery
from quadweave.plans.algebra import BGP, Bind, Expr, Graph, Group, Minus, Optional, Path, Query, Select, Triple, Union, Update, Values
from quadweave.terms import RDF, TYPE, XSD, Blank, Iri, Literal, Variable, literal

_TOKEN = re.compile(
    r"""(?P<ws>\s+|\#[^\n]*)
    |(?P<iri><[^<>"{}|^`\\\s]*>)
    |(?P<var>[?$]\w+)
    |(?P<str>\"{3}(?:[^"\\]|\\.|\"(?!\"\"))*\"{3}|'{3}(?:[^'\\]|\\.|'(?!''))*'{3}|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')
    |(?P<lang>@[a-zA-Z]+(?:-[a-zA-Z0-9]+)*)
    |(?P<num>(?:\d+\.?\d*|\.\d+)[eE][+-]?\d+|\d*\.\d+|\d+)
    |(?P<blank>_:[\w.-]*\w)
    |(?P<name>[A-Za-z_À-�][\w.-]*(?<!\.):(?:[\w:%-]|\.(?=[\w:%-])|\\.)*|:(?:[\w:%-]|\.(?=[\w:%-])|\\.)+|[A-Za-z_]\w*(?=:)(?::)|:)
    |(?P<word>[A-Za-z_]\w*)
    |(?P<op>\^\^|&&|\|\||!=|<=|>=|[{}()\[\].;,=<>!+*/?|^-])""",
    re.VERBOSE | re.UNICODE | re.DOTALL,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}
_AGGREGATES = {"COUNT", "SUM", "AVG", "MIN", "MAX", "SAMPLE", "GROUP_CONCAT"}


def _unescape(s: str) -> str:
    def one(m: re.Match) -> str:
        x = m[1]
        return chr(int(x[1:], 16)) if x[0] in "uU" and len(x) > 1 else _ESCAPES.get(x, x)

    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", one, s, flags=re.DOTALL)


class Parser:
    def __init__(self, text: str, base: str = "") -> None:
        self.base, self.prefixes, self.fresh, self.at = base, {"xsd": XSD, "rdf": RDF}, 0, 0
        self.tokens, pos = [], 0
        while pos < len(text):
            m = _TOKEN.match(text, pos)
            if not m:
                raise SparqlSyntaxError(f"unexpected {text[pos : pos + 20]!r}")
            if m.lastgroup != "ws":
                self.tokens.append((m.lastgroup, m[0]))
            pos = m.end()

    # -- tokens
    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def word(self, *words: str) -> bool:
        kind, text = self.peek()
        return kind == "word" and text.upper() in words

    def take(self, *texts: str) -> str | None:
        kind, text = self.peek()
        if kind != "str" and (text in texts or kind == "word" and text.upper() in texts):
            self.at += 1
            return text.upper() if kind == "word" else text
        return None

    def need(self, *texts: str) -> str:
        got = self.take(*texts)
        if got is None:
            raise SparqlSyntaxError(f"expected {' or '.join(texts)}, found {self.peek()[1]!r}")
        return got

    def new(self) -> Variable:
        self.fresh += 1
        return Variable(f"_b{self.fresh}")

    # -- terms
    def is_iri(self) -> bool:
        return self.peek()[0] in ("iri", "name")

    def iri(self) -> str:
        kind, text = self.peek()
        self.at += 1
        if kind == "iri":
            return urljoin(self.base, text[1:-1]) if self.base else text[1:-1]
        if kind == "name":
            prefix, _, local = text.partition(":")
            if prefix not in self.prefixes:
                raise SparqlSyntaxError(f"unknown prefix {prefix!r}")
            return self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local)
        raise SparqlSyntaxError(f"expected an IRI, found {text!r}")

    def literal(self) -> Literal:
        kind, text = self.peek()
        sign = self.take("-", "+") if text in "+-" and text else ""
        kind, text = self.peek()
        self.at += 1
        if kind == "num":
            datatype = "double" if "e" in text.lower() else "decimal" if "." in text else "integer"
            return Literal((sign if sign == "-" else "") + text, XSD + datatype)
        if kind == "word" and text.lower() in ("true", "false"):
            return Literal(text.lower(), XSD + "boolean")
        if kind != "str":
            raise SparqlSyntaxError(f"expected a literal, found {text!r}")
        q = 3 if text[:3] in ('"""', "'''") else 1
        value = _unescape(text[q:-q])
        if self.peek()[0] == "lang":
            self.at += 1
            return literal(value, lang=self.peek(-1)[1][1:])
        if self.take("^^"):
            return literal(value, self.iri())
        return Literal(value)

    def term(self):
        kind, text = self.peek()
        if kind == "var":
            self.at += 1
            return Variable(text[1:])
        if kind in ("iri", "name"):
            return Iri(self.iri())
        if kind == "blank":
            self.at += 1
            return Blank(text[2:])
        return self.literal()

    # -- patterns
    def group(self) -> Group:
        self.need("{")
        out = Group()
        if self.word("SELECT"):
            out.elements.append(self.select())
            self.need("}")
            return out
        while not self.take("}"):
            if self.take("OPTIONAL"):
                out.elements.append(Optional(self.group()))
            elif self.take("MINUS"):
                out.elements.append(Minus(self.group()))
            elif self.take("GRAPH"):
                name = self.term()
                out.elements.append(Graph(name, self.group()))
            elif self.take("SERVICE"):
                raise DisabledFeature("SERVICE is not allowed")
            elif self.take("FILTER"):
                out.filters.append(self.constraint())
            elif self.take("BIND"):
                self.need("(")
                e = self.expr()
                self.need("AS")
                out.elements.append(Bind(e, self.var()))
                self.need(")")
            elif self.take("VALUES"):
                out.elements.append(self.values())
            elif self.peek()[1] == "{":
                branches = [self.group()]
                while self.take("UNION"):
                    branches.append(self.group())
                out.elements.append(Union(branches) if len(branches) > 1 else branches[0])
            elif self.take("."):
                continue
            else:
                triples = self.triples()
                if out.elements and isinstance(out.elements[-1], BGP):
                    out.elements[-1].triples += triples
                else:
                    out.elements.append(BGP(triples))
        return out

    def var(self) -> str:
        kind, text = self.peek()
        if kind != "var":
            raise SparqlSyntaxError(f"expected a variable, found {text!r}")
        self.at += 1
        return text[1:]

    def values(self) -> Values:
        names, rows = [], []
        if self.take("("):
            while not self.take(")"):
                names.append(self.var())
            several = True
        else:
            names, several = [self.var()], False
        self.need("{")
        while not self.take("}"):
            if several:
                self.need("(")
                row = []
                while not self.take(")"):
                    row.append(None if self.take("UNDEF") else self.term())
            else:
                row = [None if self.take("UNDEF") else self.term()]
            if len(row) != len(names):
                raise SparqlSyntaxError("VALUES row of another length")
            rows.append(row)
        return Values(names, rows)

    def triples(self) -> list[Triple]:
        out: list[Triple] = []
        subject = self.node(out)
        if self.peek()[1] in (".", "}") and out:
            return out
        self.properties(subject, out)
        return out

    def properties(self, subject, out: list[Triple]) -> None:
        while True:
            verb = self.verb()
            while True:
                obj = self.node(out)
                out.append(Triple(subject, verb, obj))
                if not self.take(","):
                    break
            if not self.take(";"):
                return
            while self.take(";"):
                pass
            if self.peek()[1] in (".", "}", "]"):
                return

    def node(self, out: list[Triple]):
        if self.take("["):
            node = self.new()
            if not self.take("]"):
                self.properties(node, out)
                self.need("]")
            return node
        if self.take("("):
            items = []
            while not self.take(")"):
                items.append(self.node(out))
            head = Iri(RDF + "nil")
            for x in reversed(items):
                cell = self.new()
                out += [Triple(cell, Iri(RDF + "first"), x), Triple(cell, Iri(RDF + "rest"), head)]
                head = cell
            return head
        if self.peek()[1] == "<" and self.peek(1)[1] == "<":
            raise UnsupportedQuery("nested triples are not supported")
        t = self.term()
        return Variable(f"_n{t.value}") if isinstance(t, Blank) else t

    def verb(self):
        if self.peek()[0] == "var":
            return self.term()
        return self.path()

    def path(self):
        parts = [self.path_sequence()]
        while self.take("|"):
            parts.append(self.path_sequence())
        return parts[0] if len(parts) == 1 else Path("alt", tuple(parts))

    def path_sequence(self):
        parts = [self.path_step()]
        while self.take("/"):
            parts.append(self.path_step())
        return parts[0] if len(parts) == 1 else Path("seq", tuple(parts))

    def path_step(self):
        if self.take("^"):
            return Path("inv", (self.path_step(),))
        if self.take("!"):
            items = []
            if self.take("("):
                while not self.take(")"):
                    items.append(Path("inv", (self.path_primary(),)) if self.take("^") else self.path_primary())
                    self.take("|")
            else:
                items.append(Path("inv", (self.path_primary(),)) if self.take("^") else self.path_primary())
            return Path("neg", tuple(items))
        p = self.path_primary()
        m = self.take("*", "+", "?")
        return Path({"*": "star", "+": "plus", "?": "opt"}[m], (p,)) if m else p

    def path_primary(self):
        if self.take("("):
            p = self.path()
            self.need(")")
            return p
        if self.peek() == ("word", "a"):
            self.at += 1
            return Iri(TYPE)
        return Iri(self.iri())

    # -- expressions
    def constraint(self) -> Expr:
        if self.peek()[1] == "(":
            self.need("(")
            e = self.expr()
            self.need(")")
            return e
        return self.primary()

    def expr(self) -> Expr:
        return self.binary(0)

    _LEVELS = (("||",), ("&&",), ("=", "!=", "<", ">", "<=", ">="), ("+", "-"), ("*", "/"))

    def binary(self, level: int) -> Expr:
        if level == len(self._LEVELS):
            return self.unary()
        left = self.binary(level + 1)
        while True:
            if level == 2 and (self.word("IN") or self.word("NOT") and self.peek(1)[1].upper() == "IN"):
                op = "notin" if self.take("NOT") else "in"
                self.need("IN")
                left = Expr(op, [left, *self.arguments()])
                continue
            op = self.take(*self._LEVELS[level])
            if not op:
                return left
            left = Expr(op, [left, self.binary(level + 1)])

    def unary(self) -> Expr:
        if self.take("!"):
            return Expr("not", [self.unary()])
        if self.take("-"):
            return Expr("neg", [self.unary()])
        self.take("+")
        return self.primary()

    def arguments(self) -> list[Expr]:
        self.need("(")
        out = []
        while not self.take(")"):
            out.append(self.expr())
            self.take(",")
        return out

    def primary(self) -> Expr:
        kind, text = self.peek()
        if text == "(" and kind == "op":
            self.at += 1
            e = self.expr()
            self.need(")")
            return e
        if kind == "var":
            self.at += 1
            return Expr("var", name=text[1:])
        if kind in ("iri", "name"):
            iri = self.iri()
            return Expr("call", self.arguments(), name=iri) if self.peek()[1] == "(" else Expr("term", [Iri(iri)])
        if kind == "word" and text.lower() not in ("true", "false"):
            self.at += 1
            name = text.upper()
            if name == "EXISTS":
                return Expr("exists", [self.group()])
            if name == "NOT":
                self.need("EXISTS")
                return Expr("notexists", [self.group()])
            if name in _AGGREGATES:
                self.need("(")
                distinct = bool(self.take("DISTINCT"))
                args = [] if self.take("*") else [self.expr()]
                out = Expr("agg", args, name, distinct)
                if self.take(";"):
                    self.need("SEPARATOR")
                    self.need("=")
                    out.args.append(Expr("term", [self.literal()]))
                self.need(")")
                return out
            return Expr("call", self.arguments(), name=name)
        return Expr("term", [self.literal()])

    # -- queries
    def prologue(self) -> None:
        while True:
            if self.take("PREFIX"):
                name = self.peek()[1]
                self.at += 1
                self.prefixes[name.rstrip(":")] = self.iri()
            elif self.take("BASE"):
                self.base = self.iri()
            else:
                return

    def select(self) -> Select:
        self.need("SELECT")
        distinct = bool(self.take("DISTINCT"))
        self.take("REDUCED")
        projection: list | None = []
        if self.take("*"):
            projection = None
        else:
            while self.peek()[0] == "var" or self.peek()[1] == "(":
                if self.take("("):
                    e = self.expr()
                    self.need("AS")
                    projection.append((self.var(), e))
                    self.need(")")
                else:
                    projection.append((self.var(), None))
            if not projection:
                raise SparqlSyntaxError("SELECT of nothing")
        self.datasets()
        self.take("WHERE")
        out = Select(self.group(), projection, distinct)
        self.modifiers(out)
        return out

    def modifiers(self, out: Select) -> None:
        if self.take("GROUP"):
            self.need("BY")
            out.group = []
            while self.peek()[0] == "var" or self.peek()[1] == "(" or self.peek()[0] in ("iri", "name") or self.peek()[0] == "word" and self.peek(1)[1] == "(" and not self.word("HAVING"):
                if self.take("("):
                    e = self.expr()
                    name = self.var() if self.take("AS") else None
                    self.need(")")
                    out.group.append((e, name))
                else:
                    e = self.primary()
                    out.group.append((e, e.name if e.op == "var" else None))
        if self.take("HAVING"):
            while self.peek()[1] == "(" or self.peek()[0] == "word" and self.peek(1)[1] == "(":
                out.having.append(self.constraint())
        if self.take("ORDER"):
            self.need("BY")
            while True:
                direction = self.take("ASC", "DESC")
                if direction or self.peek()[1] == "(" or self.peek()[0] == "word" and self.peek(1)[1] == "(":
                    out.order.append((self.constraint(), direction == "DESC"))
                elif self.peek()[0] == "var":
                    out.order.append((self.primary(), False))
                else:
                    break
        while self.word("LIMIT", "OFFSET"):
            which = self.take("LIMIT", "OFFSET")
            n = max(0, int(self.literal().value))
            if which == "LIMIT":
                out.limit = n
            else:
                out.offset = n
        if self.take("VALUES"):
            out.values = self.values()

    def datasets(self) -> None:
        while self.take("FROM"):
            (self.named if self.take("NAMED") else self.default).append(self.iri())

    def query(self) -> Query:
        self.default, self.named = [], []
        self.prologue()
        if self.word("SELECT"):
            out = Query("select", self.select())
        elif self.take("ASK"):
            self.datasets()
            self.take("WHERE")
            out = Query("ask", Select(self.group()))
            self.modifiers(out.select)
        elif self.take("CONSTRUCT"):
            if self.peek()[1] == "{":
                template = [t for _, t in self.quads()]
                self.datasets()
                self.need("WHERE")
                out = Query("construct", Select(self.group()), template=template)
            else:
                self.datasets()
                self.need("WHERE")
                group = self.group()
                out = Query("construct", Select(group), template=[t for e in group.elements for t in e.triples])
            self.modifiers(out.select)
        elif self.take("DESCRIBE"):
            targets = []
            if not self.take("*"):
                while self.peek()[0] == "var" or self.is_iri():
                    targets.append(self.term())
            self.datasets()
            self.take("WHERE")
            out = Query("describe", Select(self.group() if self.peek()[1] == "{" else Group()), targets=targets)
            self.modifiers(out.select)
        else:
            raise SparqlSyntaxError(f"no query form at {self.peek()[1]!r}")
        if self.peek()[0] != "end":
            raise SparqlSyntaxError(f"unexpected {self.peek()[1]!r} after the query")
        out.default_graphs, out.named_graphs = self.default, self.named
        return out

    # -- updates
    def quads(self) -> list[tuple]:
        """{ triples and GRAPH blocks } as (graph, triple); blank nodes stay blank nodes."""
        out: list[tuple] = []
        self.need("{")
        while not self.take("}"):
            if self.take("."):
                continue
            if self.take("GRAPH"):
                g = self.term()
                out += [(g, t) for _, t in self.quads()]
            else:
                out += [(None, t) for t in self.triples()]
        return out

    def graph_ref(self):
        if self.take("DEFAULT", "NAMED", "ALL"):
            return self.peek(-1)[1].upper()
        self.take("GRAPH")
        return Iri(self.iri())

    def updates(self) -> list[Update]:
        out = []
        while self.peek()[0] != "end":
            self.prologue()
            if self.peek()[0] == "end":
                break
            out.append(self.update())
            self.take(";")
        if len(out) > 1 and any(u.op in ("clear", "drop", "add", "copy", "move") for u in out):
            raise UnsupportedQuery("graph management stands alone in a request")
        return out

    def update(self) -> Update:
        if self.take("LOAD"):
            raise DisabledFeature("LOAD is not allowed")
        op = self.take("CLEAR", "DROP", "CREATE", "ADD", "COPY", "MOVE")
        if op:
            self.take("SILENT")
            if op in ("CLEAR", "DROP", "CREATE"):
                return Update(op.lower(), target=self.graph_ref())
            source = self.graph_ref()
            self.need("TO")
            return Update(op.lower(), source=source, target=self.graph_ref())
        with_graph = self.iri() if self.take("WITH") else None
        out = Update("modify", with_graph=with_graph)
        if self.take("DELETE"):
            if self.take("DATA"):
                return Update("delete_data", delete=self.quads())
            if self.take("WHERE"):
                at = self.at
                out.delete = self.quads()
                self.at = at
                out.pattern = self.group()
                return out
            out.delete = self.quads()
        if self.take("INSERT"):
            if self.take("DATA"):
                return Update("insert_data", insert=self.quads())
            out.insert = self.quads()
        while self.take("USING"):
            (out.using_named if self.take("NAMED") else out.using).append(self.iri())
        self.need("WHERE")
        out.pattern = self.group()
        return out


def parse_query(text: str, base: str = "") -> Query:
    return Parser(text, base).query()


def parse_update(text: str, base: str = "") -> list[Update]:
    return Parser(text, base).updates()
