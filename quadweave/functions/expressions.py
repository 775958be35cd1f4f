"""SPARQL expressions as Columns. An error and an unbound variable are both null; filters take null as false."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quadweave.errors import UnsupportedQuery
from quadweave.plans.algebra import Expr
from quadweave.terms import EXACT, INTEGER_IRIS, LANG_STRING, NUMERIC_IRIS, XSD, Literal, Val, boolean, constant, digits, make, null, number, number_of, instant_of, same, string

_FN = "http://www.w3.org/2005/xpath-functions#"
# The XPath names of string functions, and the SPARQL functions they stand for.
_ALIASES = {
    "lower-case": "LCASE", "upper-case": "UCASE", "substring": "SUBSTR", "string-length": "STRLEN", "contains": "CONTAINS",
    "starts-with": "STRSTARTS", "ends-with": "STRENDS", "matches": "REGEX", "concat": "CONCAT", "replace": "REPLACE",
}
Scope = Callable[[str], Val | None]


def truth(v: Val) -> Column:
    """The effective boolean value; null if there is none."""
    if v.b is not None:
        return v.b
    flag = F.when(v.d == XSD + "boolean", v.v.isin("true", "1"))
    num = F.when(v.d.isin(NUMERIC_IRIS), F.coalesce((v.n != 0) & ~F.isnan(v.n), F.lit(False)))
    text = F.when((v.k == "literal") & v.d.isNull(), F.length(v.v) > 0)
    return F.coalesce(flag, num, text)


def _both(a: Val, b: Val, datatype: str) -> Column:
    return (a.d == datatype) & (b.d == datatype)


def compared(a: Val, b: Val, f: Callable[[Column, Column], Column]) -> Column:
    """f of two numbers; of integers beyond what doubles hold, with all their digits."""
    if a.small or b.small:
        return f(a.n, b.n)
    x, y = digits(a), digits(b)
    large = (F.abs(a.n) >= EXACT) & (F.abs(b.n) >= EXACT) & x.isNotNull() & y.isNotNull()
    return F.when(large, f(x, y)).otherwise(f(a.n, b.n))


def equal(a: Val, b: Val) -> Column:
    """= by value: numbers and instants by what they mean; unlike literals that may be equal are an error (null)."""
    numbers = a.n.isNotNull() & b.n.isNotNull()
    known = F.coalesce(a.d, F.lit(""))
    plain = (a.k != "literal") | (b.k != "literal") | ((known == F.coalesce(b.d, F.lit(""))) & known.isin("", LANG_STRING))
    return (
        F.when(a.v.isNull() | b.v.isNull(), F.lit(None).cast("boolean"))
        .when(numbers, compared(a, b, lambda x, y: x == y) & ~F.isnan(a.n))
        .when(a.t.isNotNull() & b.t.isNotNull(), a.t == b.t)
        .when(_both(a, b, XSD + "boolean"), a.v.isin("true", "1") == b.v.isin("true", "1"))
        .when(same(a, b), True)
        .when(plain, False)
    )


def _static(v: Val, what: str) -> bool:
    return getattr(v, "static", None) == what


def less(a: Val, b: Val, op: str) -> Column:
    """Orders numbers, instants, booleans and plain strings; other pairs are an error."""
    f = {"<": lambda x, y: x < y, ">": lambda x, y: x > y, "<=": lambda x, y: x <= y, ">=": lambda x, y: x >= y}[op]
    if a.small or b.small:  # a constant that doubles hold
        if _static(a, "n") or _static(b, "n"):
            return f(a.n, b.n)
    elif _static(a, "n") or _static(b, "n"):
        return compared(a, b, f)
    if _static(a, "t") or _static(b, "t"):
        return f(a.t, b.t)
    numbers = a.n.isNotNull() & b.n.isNotNull()
    text = (a.k == "literal") & (b.k == "literal") & a.d.isNull() & b.d.isNull() & a.l.eqNullSafe(b.l)
    flags = _both(a, b, XSD + "boolean")
    return F.when(numbers, compared(a, b, f) & ~F.isnan(a.n) & ~F.isnan(b.n)).when(a.t.isNotNull() & b.t.isNotNull(), f(a.t, b.t)).when(text, f(a.v, b.v)).when(flags, f(a.v.isin("true", "1").cast("int"), b.v.isin("true", "1").cast("int")))


def _promoted(a: Val, b: Val, division: bool = False) -> Column:
    double = (a.d == XSD + "double") | (b.d == XSD + "double")
    single = (a.d == XSD + "float") | (b.d == XSD + "float")
    whole = a.d.isin(INTEGER_IRIS) & b.d.isin(INTEGER_IRIS)
    out = F.when(double, XSD + "double").when(single, XSD + "float")
    return out.otherwise(XSD + "decimal") if division else out.when(whole, XSD + "integer").otherwise(XSD + "decimal")


def arithmetic(op: str, a: Val, b: Val) -> Val:
    n = {"+": a.n + b.n, "-": a.n - b.n, "*": a.n * b.n, "/": F.when(b.n != 0, a.n / F.when(b.n != 0, b.n))}[op]
    d = _promoted(a, b, op == "/")
    if op == "/":
        return number(n, d)
    f = {"+": F.try_add, "-": F.try_subtract, "*": F.try_multiply}[op]
    return number(n, d, F.when(F.abs(n) >= EXACT, f(digits(a), digits(b))))


def _text(v: Val) -> Column:
    """The value of a string literal, else an error."""
    return F.when((v.k == "literal") & v.d.isNull(), v.v)


def _like(v: Val, text: Column) -> Val:
    return make("literal", text, None, F.when(text.isNotNull(), v.l))


def _found(a: Val, b: Val, part: Callable[[Column], Column]) -> Val:
    """What part() takes of a by the place of b in it; the empty string, without a language, where b does not occur."""
    at = F.call_function("locate", _text(b), _text(a), F.lit(1))
    return make("literal", F.when(at > 0, part(at)).when(at == 0, ""), None, F.when(at > 0, a.l))


def _pick(cases: list[tuple[Column | None, Val]]) -> Val:
    """The Val of the first case whose condition holds; a condition of None always does."""
    def field(f: str) -> Column:
        out = None
        for cond, v in cases:
            c = getattr(v, f)
            if cond is None:
                return c if out is None else out.otherwise(c)
            out = F.when(cond, c) if out is None else out.when(cond, c)
        return out

    return Val(*(field(f) for f in ("k", "v", "d", "l", "n", "t")))


def pattern(flags: str | None, text: str) -> str:
    """A Java pattern with inline flags; q takes the text literally."""
    flags = flags or ""
    if "q" in flags:
        text = "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    inline = "".join(f for f in flags if f in "ismx")
    return f"(?{inline})" * bool(inline) + text


def regex(text: Column, p: Expr | str, flags: str | None, scope: Scope | None = None) -> Column:
    if isinstance(p, str):
        return text.rlike(pattern(flags, p))
    return F.rlike(text, F.concat(F.lit(f"(?{''.join(f for f in flags or '' if f in 'ismx')})" if flags else ""), compile_expr(p, scope).v))


def lang_matches(tag: Column, wanted: Column) -> Column:
    tag, wanted = F.lower(tag), F.lower(wanted)
    return F.when(wanted == "*", F.length(tag) > 0).otherwise((tag == wanted) | tag.startswith(F.concat(wanted, F.lit("-"))))


def substring(v: Val, start: Column, length: Column | None) -> Column:
    """1-based, arguments rounded; a start before 1 is clamped to the beginning and does not shorten the length."""
    begin = F.greatest(F.round(start), F.lit(1)).cast("int")
    return F.substr(v.v, begin) if length is None else F.substr(v.v, begin, F.greatest(F.round(length), F.lit(0)).cast("int"))


def _constant_text(e: Expr) -> str | None:
    return e.args[0].value if e.op == "term" and isinstance(e.args[0], Literal) else None


def _resolve(v: Val, base: str) -> Column:
    absolute = v.v.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:")
    joined = F.when(v.v.startswith("#"), F.concat(F.lit(base.split("#")[0]), v.v)).otherwise(F.concat(F.lit(base.rsplit("/", 1)[0] + "/" if "/" in base else base), v.v))
    return F.when(v.v.rlike(r"[\s<>\"{}|^`\\]"), None).when(absolute, v.v).when(F.lit(bool(base)), joined)


def call(name: str, args: list[Expr], scope: Scope, base: str = "") -> Val:  # noqa: C901
    if name.startswith(_FN):
        name = _ALIASES.get(name[len(_FN) :], name)
    if name == "BOUND":
        v = scope(args[0].name)
        return boolean(v.v.isNotNull() if v else F.lit(False))
    x = [compile_expr(a, scope, base) for a in args]
    if name == "COALESCE":
        return _pick([(v.v.isNotNull(), v) for v in x])
    if name == "IF":
        t = truth(x[0])
        return _pick([(t, x[1]), (~t, x[2])])
    if name in ("REGEX", "REPLACE"):
        flags = _constant_text(args[-1]) if len(args) > (2 if name == "REGEX" else 3) else None
        p = _constant_text(args[1])
        if name == "REGEX":
            return boolean(regex(_text(x[0]), p if p is not None else args[1], flags, scope))
        if p is None:
            raise UnsupportedQuery("REPLACE needs a constant pattern")
        return _like(x[0], F.regexp_replace(_text(x[0]), F.lit(pattern(flags, p)), x[2].v))
    a = x[0] if x else None
    b = x[1] if len(x) > 1 else None
    if name == "STR":
        return string(F.when(a.k != "blank", a.v))
    if name == "LANG":
        return string(F.when(a.k == "literal", F.coalesce(a.l, F.lit(""))))
    if name == "DATATYPE":
        return make("iri", F.when(a.k == "literal", F.when(a.l.isNotNull(), LANG_STRING).otherwise(F.coalesce(a.d, F.lit(XSD + "string")))))
    if name in ("IRI", "URI"):
        return make("iri", F.when((a.k == "iri") | a.d.isNull(), _resolve(a, base)))
    if name in ("LCASE", "UCASE"):
        return string((F.lower if name == "LCASE" else F.upper)(_text(a)))
    if name == "STRLEN":
        return number(F.length(_text(a)).cast("double"), "integer")
    if name == "SUBSTR":
        return string(substring(Val(a.k, _text(a), a.d, a.l, a.n, a.t), b.n, x[2].n if len(x) > 2 else None))
    if name == "CONCAT":
        return string(F.concat(*(v.v for v in x)) if x else F.lit(""))
    if name in ("CONTAINS", "STRSTARTS", "STRENDS"):
        return boolean({"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[name](_text(a), _text(b)))
    if name == "STRBEFORE":
        return _found(a, b, lambda at: F.substr(a.v, F.lit(1), at - 1))
    if name == "STRAFTER":
        return _found(a, b, lambda at: F.substr(a.v, at + F.length(b.v)))
    if name == "ENCODE_FOR_URI":
        return string(F.replace(F.replace(F.url_encode(_text(a)), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~")))
    if name == "STRDT":
        d = F.when(b.k == "iri", b.v)
        v = F.when(d.isNotNull(), _text(a))
        return make("literal", v, F.when(v.isNotNull() & (d != XSD + "string"), d), None, number_of(v, d), instant_of(v, d))
    if name == "STRLANG":
        return make("literal", F.when(b.v.isNotNull(), _text(a)), None, F.lower(b.v))
    if name == "LANGMATCHES":
        return boolean(lang_matches(a.v, b.v))
    if name == "SAMETERM":
        return boolean(same(a, b))
    if name in ("ISIRI", "ISURI", "ISBLANK", "ISLITERAL"):
        return boolean(a.k == {"ISBLANK": "blank", "ISLITERAL": "literal"}.get(name, "iri"))
    if name == "ISNUMERIC":
        return boolean(F.when(a.v.isNotNull(), a.n.isNotNull()))
    if name in ("ABS", "CEIL", "FLOOR", "ROUND"):
        f = {"ABS": F.abs, "CEIL": lambda c: F.ceil(c).cast("double"), "FLOOR": lambda c: F.floor(c).cast("double"), "ROUND": lambda c: F.floor(c + 0.5).cast("double")}[name]
        return number(f(a.n), a.d)
    if name == "RAND":
        return number(F.rand(), "double")
    if name in ("YEAR", "MONTH", "DAY", "HOURS", "MINUTES"):
        f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[name]
        return number(f(a.t).cast("double"), "integer")
    if name == "SECONDS":
        return number(F.extract(F.lit("SECOND"), a.t).cast("double"), "decimal")
    if name in ("TZ", "TIMEZONE"):
        zone = F.regexp_extract(F.when(a.t.isNotNull(), a.v), r"(Z|[+-]\d\d:\d\d)$", 1)
        if name == "TZ":
            return string(zone)
        hours, minutes = F.substring(zone, 2, 2).try_cast("int"), F.substring(zone, 5, 2).try_cast("int")
        span = F.concat(F.when(zone.startswith("-"), "-PT").otherwise("PT"), F.when(hours > 0, F.concat(hours.cast("string"), F.lit("H"))).otherwise(""), F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit("M"))).otherwise(""))
        return make("literal", F.when(zone == "Z", "PT0S").when(zone != "", F.when(hours + minutes == 0, "PT0S").otherwise(span)), XSD + "dayTimeDuration")
    if name == "NOW":
        return make("literal", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"), XSD + "dateTime", None, None, F.current_timestamp())
    if name in ("MD5", "SHA1", "SHA256", "SHA384", "SHA512"):
        t = _text(a).cast("binary")
        return string(F.md5(t) if name == "MD5" else F.sha1(t) if name == "SHA1" else F.sha2(t, int(name[3:])))
    if name in ("UUID", "STRUUID"):
        return string(F.uuid()) if name == "STRUUID" else make("iri", F.concat(F.lit("urn:uuid:"), F.uuid()))
    if name == "BNODE":
        return make("blank", F.concat(F.lit("b"), F.uuid()) if a is None else F.concat(F.lit("b"), F.md5(a.v.cast("binary"))))
    if name.startswith(XSD):
        return cast(name[len(XSD) :], a)
    raise UnsupportedQuery(f"unknown function {name}")


def cast(to: str, a: Val) -> Val:
    if to == "string":
        return string(F.when(a.k != "blank", a.v))
    if to == "boolean":
        return boolean(F.coalesce(F.when(a.n.isNotNull(), a.n != 0), F.when(a.v.isin("true", "1"), True).when(a.v.isin("false", "0"), False)))
    if to == "dateTime":
        t = F.coalesce(a.t, F.try_to_timestamp(a.v))
        return make("literal", F.when(t.isNotNull(), a.v), XSD + to, None, None, t)
    n = F.coalesce(a.n, F.when(a.v.isin("true", "false"), (a.v == "true").cast("double")), a.v.try_cast("double"))
    n = F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.when(F.lit(to in ("double", "float")), n)).otherwise(n)
    return number(F.when(n < 0, F.ceil(n)).otherwise(F.floor(n)).cast("double") if XSD + to in INTEGER_IRIS else n, to)


def compile_expr(e: Expr, scope: Scope, base: str = "") -> Val:
    """The value of an expression; scope gives the Val of a variable, None if it is never bound."""
    if e.op == "var":
        v = scope(e.name)
        return v if v is not None else Val(*(null(f) for f in ("k", "v", "d", "l", "n", "t")))
    if e.op == "term":
        return constant(e.args[0])
    if e.op == "call":
        return call(e.name, e.args, scope, base)
    if e.op in ("&&", "||"):
        a, b = (truth(compile_expr(x, scope, base)) for x in e.args)
        return boolean(a & b if e.op == "&&" else a | b)
    if e.op == "not":
        return boolean(~truth(compile_expr(e.args[0], scope, base)))
    if e.op == "neg":
        a = compile_expr(e.args[0], scope, base)
        return number(-a.n, a.d)
    if e.op in ("in", "notin"):
        a, *rest = (compile_expr(x, scope, base) for x in e.args)
        if all(x.op == "term" and isinstance(x.args[0], Literal) and x.args[0].datatype is None and x.args[0].lang is None for x in e.args[1:]) and _static(a, "v"):
            found = a.v.isin([x.args[0].value for x in e.args[1:]])
        else:
            found = reduce(lambda p, q: p | q, (equal(a, x) for x in rest), F.lit(False))
        return boolean(found if e.op == "in" else ~found)
    a, b = (compile_expr(x, scope, base) for x in e.args)
    if e.op in ("=", "!="):
        n = _static(a, "n") and (e.args[1].op == "term") and b.n is not None and isinstance(e.args[1].args[0], Literal) and e.args[1].args[0].datatype in NUMERIC_IRIS
        plain = _static(a, "v") and e.args[1].op == "term" and isinstance(e.args[1].args[0], Literal) and e.args[1].args[0].datatype is None and e.args[1].args[0].lang is None
        q = a.n == b.n if n and b.small else a.v == b.v if plain else equal(a, b)
        return boolean(q if e.op == "=" else ~q)
    if e.op in ("<", ">", "<=", ">="):
        return boolean(less(a, b, e.op))
    if e.op in "+-*/":
        return arithmetic(e.op, a, b)
    raise UnsupportedQuery(f"{e.op} is not allowed here")


def condition(e: Expr, scope: Scope, base: str = "") -> Column:
    return F.coalesce(truth(compile_expr(e, scope, base)), F.lit(False))
