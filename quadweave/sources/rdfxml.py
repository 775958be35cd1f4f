"""RDF/XML documents as quads."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import count
from urllib.parse import urljoin

from quadweave.errors import UnsupportedQuery
from quadweave.terms import XSD

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
_XML = "{http://www.w3.org/XML/1998/namespace}"
# Attributes of the syntax itself, which state no property.
_SYNTAX = {RDF + x for x in ("about", "ID", "nodeID", "resource", "datatype", "parseType")}


def _name(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


class _Document:
    """Walks elements of nodes and properties in turn; rows (sk, s, p, ok, o, od, ol) are gathered in `rows`."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.numbers = count(1)

    def fresh(self) -> tuple[str, str]:
        return "blank", f"x{next(self.numbers)}"

    def add(self, subject: tuple[str, str], predicate: str, kind: str, value: str, datatype: str | None = None, lang: str | None = None) -> None:
        self.rows.append((*subject, predicate, kind, value, None if datatype == XSD + "string" else datatype, lang.lower() if lang else None))

    @staticmethod
    def context(el: ET.Element, base: str, lang: str | None) -> tuple[str, str | None]:
        return el.get(_XML + "base", base), el.get(_XML + "lang", lang)

    @staticmethod
    def iri(reference: str, base: str) -> str:
        whole = base.partition("#")[0]
        return whole + reference if not reference or reference.startswith("#") else urljoin(base, reference)

    def named(self, el: ET.Element, base: str, about: str) -> tuple[str, str] | None:
        """The node that an element refers to by IRI, label or fragment."""
        own = {_name(k): v for k, v in el.items()}
        if RDF + about in own:
            return "iri", self.iri(own[RDF + about], base)
        if RDF + "nodeID" in own:
            return "blank", own[RDF + "nodeID"]
        return ("iri", self.iri("#" + own[RDF + "ID"], base)) if about == "about" and RDF + "ID" in own else None

    def attributes(self, el: ET.Element, subject: tuple[str, str], base: str, lang: str | None) -> None:
        for k, v in el.items():
            p = _name(k)
            if p == RDF + "type":
                self.add(subject, p, "iri", self.iri(v, base))
            elif p not in _SYNTAX and not k.startswith(_XML) and k.startswith("{"):
                self.add(subject, p, "literal", v, None, lang)

    def node(self, el: ET.Element, base: str, lang: str | None) -> tuple[str, str]:
        base, lang = self.context(el, base, lang)
        me = self.named(el, base, "about") or self.fresh()
        if _name(el.tag) != RDF + "Description":
            self.add(me, RDF + "type", "iri", _name(el.tag))
        self.attributes(el, me, base, lang)
        self.properties(el, me, base, lang)
        return me

    def properties(self, el: ET.Element, subject: tuple[str, str], base: str, lang: str | None) -> None:
        members = count(1)
        for child in el:
            p = _name(child.tag)
            self.property(child, subject, f"{RDF}_{next(members)}" if p == RDF + "li" else p, base, lang)

    def property(self, el: ET.Element, subject: tuple[str, str], p: str, base: str, lang: str | None) -> None:
        base, lang = self.context(el, base, lang)
        value = self.value(el, base, lang)
        self.add(subject, p, *value)
        if (label := el.get(f"{{{RDF}}}ID")) is not None:  # the statement has a name of its own
            me = "iri", self.iri("#" + label, base)
            self.add(me, RDF + "type", "iri", RDF + "Statement")
            self.add(me, RDF + "subject", *subject)
            self.add(me, RDF + "predicate", "iri", p)
            self.add(me, RDF + "object", *value)

    def value(self, el: ET.Element, base: str, lang: str | None) -> tuple:
        parse = el.get(f"{{{RDF}}}parseType")
        if parse == "Resource":
            me = self.fresh()
            self.properties(el, me, base, lang)
            return me
        if parse == "Collection":
            return self.collection([self.node(x, base, lang) for x in el])
        if parse is not None:
            return "literal", (el.text or "") + "".join(ET.tostring(x, "unicode") for x in el), RDF + "XMLLiteral", None
        if len(el) > 1:
            raise UnsupportedQuery("a property element holds one node")
        if len(el):
            return self.node(el[0], base, lang)
        stated = any(k.startswith("{") and not k.startswith(_XML) and _name(k) not in _SYNTAX for k in el.keys())
        me = self.named(el, base, "resource") or (self.fresh() if stated else None)
        if me:
            self.attributes(el, me, base, lang)
            return me
        datatype = el.get(f"{{{RDF}}}datatype")
        return "literal", el.text or "", self.iri(datatype, base) if datatype else None, None if datatype else lang

    def collection(self, items: list[tuple[str, str]]) -> tuple[str, str]:
        rest = "iri", RDF + "nil"
        for item in reversed(items):
            cell = self.fresh()
            self.add(cell, RDF + "first", *item)
            self.add(cell, RDF + "rest", *rest)
            rest = cell
        return rest


def parse_rdf_xml(text: str, base: str = "") -> Iterator[tuple]:
    """Quads (g, sk, s, p, ok, o, od, ol) of the default graph. An empty text has none; XML that is not well-formed is an error."""
    if not text.strip():
        return
    root, document = ET.fromstring(text), _Document()
    at, lang = document.context(root, base, None)
    for el in root if _name(root.tag) == RDF + "RDF" else [root]:
        document.node(el, at, lang)
    yield from (("", *row) for row in document.rows)
