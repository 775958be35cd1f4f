"""Errors of the query engine."""


class UnsupportedQuery(Exception):
    """The query asks for something that this engine does not offer."""


class DisabledFeature(UnsupportedQuery):
    """The query asks for something that policy forbids, such as SERVICE."""


class SparqlSyntaxError(ValueError):
    """The text is no SPARQL query or update."""
