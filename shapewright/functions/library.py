"""SPARQL functions as Column expressions: terms in, a term out; null is an error or nothing.

All of them stay in the JVM; fields of a result are expressions, so what a query doesn't use is pruned away.
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..terms import DIR_STRING, LANG_STRING, XSD, XSD_STRING
from .xsd import DEC, INTEGERS, LEXICAL, NUMERIC, compare, escaped, full, let, null, number, stamp, term, term_of_key, well_formed

WHOLE = [XSD + x for x in INTEGERS]
Fn = Callable[..., Column]
FUNCTIONS: dict[str, Fn] = {}


def fn(*names: str) -> Callable[[Fn], Fn]:
    def put(f: Fn) -> Fn:
        for n in names:
            FUNCTIONS[n.lower()] = f
        return f

    return put


def of(t: Column, f: str) -> Column:
    return t.getField(f)


def lex(t: Column) -> Column:
    return of(t, "lex")


def some(value: Column, make: Callable[[Column], Column]) -> Column:
    """A term of a value; null for null."""
    return F.when(value.isNotNull(), make(value))


def blank_fields() -> tuple[Column, ...]:
    return null("double"), null(DEC), null("timestamp"), null("boolean")


def string(value: Column) -> Column:
    return some(value, lambda v: term(F.concat(F.lit('"'), escaped(v), F.lit('"')), F.lit("L"), v, F.lit(XSD_STRING), null(), null(), *blank_fields()))


def boolean(value: Column) -> Column:
    text = value.cast("string")
    return some(value, lambda v: term(F.concat(F.lit('"'), text, F.lit(f'"^^<{XSD}boolean>')), F.lit("L"), text, F.lit(XSD + "boolean"), null(), null(), *blank_fields()))


def typed(text: Column, dt: Column, num: Column | None = None, dec: Column | None = None, ts: Column | None = None, tz: Column | None = None) -> Column:
    k = F.concat(F.lit('"'), escaped(text), F.when(dt == XSD_STRING, F.lit('"')).otherwise(F.concat(F.lit('"^^<'), dt, F.lit(">"))))
    return some(text, lambda v: term(k, F.lit("L"), v, dt, null(), null(), num if num is not None else null("double"), dec if dec is not None else null(DEC), ts if ts is not None else null("timestamp"), tz if tz is not None else null("boolean")))


PLACES = "decimal(37,18)"  # two of these add up without losing a place
ONE = Decimal(10) ** 18


def whole_and_rest(x: Column) -> tuple[Column, Column]:
    """The whole part of a decimal that isn't negative, and its 18 places as a number below one."""
    whole = F.floor(x).try_cast("decimal(19,0)")
    return whole, (x.try_cast(PLACES) - whole.cast(PLACES)).try_cast("decimal(18,18)")


def units(x: Column) -> Column:
    """A number of 18 places below one, in units of the last place."""
    return (x * F.lit(ONE).cast("decimal(19,0)")).try_cast("decimal(18,0)")


def decimal_text(dec: Column) -> Column:
    """A decimal in canonical form: 4.0, 0.5, -1.25."""
    whole, rest = whole_and_rest(F.abs(dec))
    places = F.regexp_replace(F.lpad(units(rest).cast("string"), 18, "0"), "0+$", "")
    out = F.concat(F.when(dec < 0, "-").otherwise(""), whole.cast("string"), F.lit("."), F.when(places == "", "0").otherwise(places))
    return F.coalesce(out, dec.cast("string"))  # 20 digits before the point


def double_text(num: Column) -> Column:
    s = num.cast("string")
    return F.when(F.isnan(num), "NaN").when(s == "Infinity", "INF").when(s == "-Infinity", "-INF").otherwise(s)


def integer(value: Column) -> Column:
    v = value.cast("decimal(38,0)")
    return typed(v.cast("string"), F.lit(XSD + "integer"), v.cast("double"), value.try_cast(DEC))


def numeric(num: Column, dec: Column, dt: Column) -> Column:
    """A number of the type dt (integer, decimal, float or double); whole and decimal ones need dec."""
    whole, exact = dt == XSD + "integer", dt == XSD + "decimal"
    text = F.when(whole, dec.cast("decimal(38,0)").cast("string")).when(exact, decimal_text(dec)).otherwise(double_text(num))
    return typed(text, dt, F.when(whole | exact, dec.cast("double")).otherwise(num), F.when(whole | exact, dec))


def wider(a: Column, b: Column) -> Column:
    """The type of a result of two numbers."""
    x, y = of(a, "dt"), of(b, "dt")
    return F.when((x == XSD + "double") | (y == XSD + "double"), XSD + "double").when((x == XSD + "float") | (y == XSD + "float"), XSD + "float").when((x == XSD + "decimal") | (y == XSD + "decimal"), XSD + "decimal").otherwise(XSD + "integer")


def is_number(t: Column) -> Column:
    return of(t, "num").isNotNull()


def ebv(t: Column) -> Column:
    """Effective boolean value; null if there is none."""
    dt = of(t, "dt")
    return (
        F.when(dt == XSD + "boolean", F.when(lex(t).isin("true", "1"), True).otherwise(False))
        .when(dt.isin(NUMERIC), F.coalesce((of(t, "num") != 0) & ~F.isnan(of(t, "num")), F.lit(False)))
        .when(dt.isin(XSD_STRING, LANG_STRING, DIR_STRING), F.length(lex(t)) > 0)
    )


def is_text(t: Column) -> Column:
    return of(t, "dt").isin(XSD_STRING, LANG_STRING, DIR_STRING)


def text(t: Column) -> Column:
    return F.when(is_text(t), lex(t))


def like(value: Column, t: Column) -> Column:
    """A string with the language of t."""
    lang, d = of(t, "lang"), of(t, "dir")
    tail = F.when(lang.isNull(), F.lit("")).otherwise(F.concat(F.lit("@"), lang, F.when(d.isNull(), "").otherwise(F.concat(F.lit("--"), d))))
    return some(value, lambda v: term(F.concat(F.lit('"'), escaped(v), F.lit('"'), tail), F.lit("L"), v, of(t, "dt"), lang, d, *blank_fields()))


def iri(value: Column) -> Column:
    return some(value, lambda v: term(F.concat(F.lit("<"), v, F.lit(">")), F.lit("I"), v, null(), null(), null(), *blank_fields()))


# -- operators


def arithmetic(name: str, exact: Callable[[Column, Column], Column], rough: Callable[[Column, Column], Column]) -> None:
    def f(a: Column, b: Column, dates: bool = True) -> Column:
        dt = wider(a, b)
        if name == "divide":
            dt = F.when(dt == XSD + "integer", XSD + "decimal").otherwise(dt)
        ok = is_number(a) & is_number(b)
        x, y = of(a, "dec"), of(b, "dec")
        dec = F.when(ok & dt.isin(XSD + "integer", XSD + "decimal"), let([x, y], lambda v: exact(*v)) if name in ("multiply", "divide") else exact(x, y))
        num = F.when(ok & dt.isin(XSD + "double", XSD + "float"), rough(of(a, "num"), of(b, "num")))
        out = let([num, dec, dt], lambda v: numeric(*v)) if name in ("multiply", "divide") else numeric(num, dec, dt)
        if dates and name in ("plus", "subtract"):
            out = F.coalesce(out, moved(a, b, name == "plus"), *([moved(b, a, True)] if name == "plus" else [between(a, b)]))
        return out

    def only_numbers(a: Column, b: Column) -> Column:
        return f(a, b, False)

    FUNCTIONS[name] = f
    FUNCTIONS[name + "#"] = only_numbers  # for operands known to be numbers: a far smaller expression


def seconds_of(t: Column) -> tuple[Column, Column]:
    """(months, microseconds) of a duration; null for others."""
    dur = of(t, "dt").isin(XSD + "duration", XSD + "dayTimeDuration", XSD + "yearMonthDuration") & full(lex(t), LEXICAL["duration"])
    sign = F.when(lex(t).startswith("-"), -1).otherwise(1)
    date, clock = F.regexp_extract(lex(t), r"^-?P([^T]*)", 1), F.regexp_extract(lex(t), r"T(.*)$", 1)

    def part(src: Column, unit: str, kind: str) -> Column:
        return F.coalesce(F.regexp_extract(src, rf"([0-9.]+){unit}", 1).try_cast(kind), F.lit(0).cast(kind))

    months = sign * (part(date, "Y", "long") * 12 + part(date, "M", "long"))
    micros = sign * ((part(date, "D", "long") * 86400 + part(clock, "H", "long") * 3600 + part(clock, "M", "long") * 60) * 1_000_000 + F.round(part(clock, "S", "decimal(20,6)") * 1_000_000).cast("long"))
    return F.when(dur, months), F.when(dur, micros)


def zone_of(t: Column) -> Column:
    return F.when(of(t, "tz"), F.regexp_extract(lex(t), r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)).otherwise("")


def offset(t: Column) -> Column:
    """Microseconds of the zone; 0 without one."""
    z = zone_of(t)
    return F.when(z.isin("", "Z"), 0).otherwise(F.when(z.startswith("-"), -1).otherwise(1) * (F.substring(z, 2, 2).try_cast("long") * 60 + F.substring(z, 5, 2).try_cast("long")) * 60_000_000)


def moved(t: Column, d: Column, forward: bool) -> Column:
    """A date or dateTime and a duration."""
    months, micros = seconds_of(d)
    if not forward:
        months, micros = -months, -micros
    local = F.timestamp_micros(F.unix_micros(of(t, "ts")) + offset(t))
    shifted = F.add_months(local.cast("date"), months.cast("int"))
    at = F.timestamp_micros(F.unix_micros(F.make_timestamp(F.year(shifted), F.month(shifted), F.dayofmonth(shifted), F.hour(local), F.minute(local), F.second(local).cast("decimal(16,6)"), F.lit("UTC"))) + F.pmod(F.unix_micros(local), F.lit(1_000_000)) + micros)
    dt = of(t, "dt")
    frac = F.regexp_replace(F.date_format(at, "SSSSSS"), "0+$", "")
    body = F.when(dt == XSD + "date", F.date_format(at, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac))))
    body = F.when(of(t, "ts").isNotNull() & micros.isNotNull(), F.concat(body, zone_of(t)))
    return typed(body, dt, ts=stamp(body, dt), tz=of(t, "tz"))


def duration_text(micros: Column) -> Column:
    a = F.abs(micros)
    d, h, m, s = (F.floor(a / x) % y if y else F.floor(a / x) for x, y in ((86_400_000_000, 0), (3_600_000_000, 24), (60_000_000, 60), (1_000_000, 60)))
    frac = F.regexp_replace(F.lpad((a % 1_000_000).cast("string"), 6, "0"), "0+$", "")
    sec = F.when((s > 0) | (frac != ""), F.concat(s.cast("string"), F.when(frac == "", "").otherwise(F.concat(F.lit("."), frac)), F.lit("S"))).otherwise("")
    clock = F.concat(F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""), sec)
    return F.concat(F.when(micros < 0, "-").otherwise(""), F.lit("P"), F.when(d > 0, F.concat(d.cast("string"), F.lit("D"))).otherwise(""), F.when(clock != "", F.concat(F.lit("T"), clock)).when(d > 0, "").otherwise("T0S"))


def between(a: Column, b: Column) -> Column:
    same = of(a, "dt") == of(b, "dt")
    micros = F.when(same, F.unix_micros(of(a, "ts")) - F.unix_micros(of(b, "ts")))
    return typed(duration_text(micros), F.lit(XSD + "dayTimeDuration"))


def cut18(x: Column) -> Column:
    return x.try_cast(DEC)


def product(x: Column, y: Column) -> Column:
    """To 18 places, half to even. Whole parts have 19 digits at most; null beyond that."""
    add = lambda a, b: F.try_add(a.try_cast(PLACES), b.try_cast(PLACES)).try_cast(PLACES)

    def summed(v: list[Column]) -> Column:
        p, r, q, t = v
        small = F.try_multiply(r, t)  # 36 places, all of them
        near = small.try_cast("decimal(19,18)")  # half up
        total = add(add(F.try_multiply(p, q).try_cast("decimal(19,0)"), F.try_multiply(p, t)), add(F.try_multiply(q, r), near))
        return let([total, F.try_subtract(small, near)], evened)

    def evened(v: list[Column]) -> Column:
        total, left = v
        tie = left == F.lit(Decimal(-5).scaleb(-19)).cast("decimal(38,36)")
        odd = units(whole_and_rest(total)[1]) % 2 == 1
        return F.when(tie & odd, F.try_subtract(total, F.lit(Decimal(1).scaleb(-18)).cast(PLACES))).otherwise(total)

    def by_whole(a: Column, b: Column) -> Column:
        """A whole number of 10 digits times one below 10^9 needs no rounding."""
        whole = a.try_cast("decimal(10,0)")
        return F.when(whole == a, whole * b.try_cast("decimal(27,18)")).try_cast(DEC)

    out = let([*whole_and_rest(F.abs(x)), *whole_and_rest(F.abs(y))], summed)
    return F.coalesce(by_whole(x, y), by_whole(y, x), let([out], lambda v: F.when((x < 0) != (y < 0), -v[0]).otherwise(v[0]).try_cast(DEC)))


def whole_quotient(x: Column, y: Column) -> Column:
    """The absolute quotient of whole numbers that are longs, the divisor up to 9 * 10^9, nine places at once; null for others."""
    nine = F.lit(10**9).cast("long")

    def div(a: Column, b: Column) -> Column:
        return F.call_function("div", a, b)

    def first(v: list[Column]) -> Column:
        n, d = v
        return let([d, div(n, d), n % d * nine], second)

    def second(v: list[Column]) -> Column:
        d, whole, more = v
        return let([d, whole, div(more, d), more % d * nine], third)

    def third(v: list[Column]) -> Column:
        d, whole, high, more = v
        return let([d, whole, high * nine + div(more, d), more % d * 2], last)

    def last(v: list[Column]) -> Column:
        d, whole, places, twice = v
        up = F.when((twice > d) | ((twice == d) & (places % 2 == 1)), 1).otherwise(0)
        tail = F.try_multiply((places + up).cast("decimal(19,0)"), F.lit(Decimal(1).scaleb(-18)).cast("decimal(18,18)"))
        return F.try_add(whole.cast(PLACES), tail.try_cast(PLACES)).try_cast(DEC)

    n, d = F.abs(x), F.abs(y)
    small = (n < F.lit(Decimal(2**63))) & (d > 0) & (d <= F.lit(Decimal(9 * 10**9))) & (n.try_cast("decimal(20,0)") == n) & (d.try_cast("decimal(20,0)") == d)
    return F.when(small, let([n.try_cast("long"), F.when(small, d.try_cast("long"))], first))


def quotient(x: Column, y: Column) -> Column:
    """To 18 places, half to even, by long division; null for a zero divisor and for whole parts of more than 19 digits."""
    big = "decimal(38,0)"

    def scaled(v: Column) -> Column:
        whole, rest = whole_and_rest(F.abs(v))
        return F.try_add(F.try_multiply(whole, F.lit(ONE).cast("decimal(19,0)")).try_cast(big), units(rest).cast(big)).try_cast(big)

    def digits(pair: Column) -> Column:
        n, d = pair.getField("n"), pair.getField("d")
        start = F.struct(F.lit(0).cast("decimal(18,0)").alias("places"), F.try_mod(n, d).try_cast(big).alias("rest"))

        def step(acc: Column, _: Column) -> Column:
            more = F.try_multiply(acc.getField("rest"), F.lit(10).cast("decimal(2,0)")).try_cast(big)
            rest = F.try_mod(more, d).try_cast(big)
            digit = F.try_divide(F.try_subtract(more, rest).try_cast(big), d).try_cast("decimal(18,0)")
            return F.struct((acc.getField("places") * F.lit(10).cast("decimal(2,0)") + digit).try_cast("decimal(18,0)").alias("places"), rest.alias("rest"))

        def whole(acc: Column) -> Column:
            rest, places = acc.getField("rest"), acc.getField("places")
            twice = F.try_multiply(rest, F.lit(2).cast("decimal(1,0)")).try_cast(big)
            up = F.when((twice > d) | ((twice == d) & (places % 2 == 1)), 1).otherwise(0).cast("decimal(19,0)")
            head = F.try_divide(F.try_subtract(n, F.try_mod(n, d).try_cast(big)).try_cast(big), d).try_cast("decimal(19,0)")
            tail = F.try_multiply((places.cast("decimal(19,0)") + up).try_cast("decimal(19,0)"), F.lit(Decimal(1).scaleb(-18)).cast("decimal(18,18)"))
            return F.try_add(head.try_cast(PLACES), tail.try_cast(PLACES)).try_cast(DEC)

        return F.aggregate(F.sequence(F.lit(1), F.lit(18)), start, step, whole)

    # the two are worked out once, and a zero divisor never gets to the steps
    pairs = F.array(F.struct(scaled(x).alias("n"), F.when(y != 0, scaled(y)).alias("d")))
    out = F.get(F.transform(F.filter(pairs, lambda p: p.getField("n").isNotNull() & p.getField("d").isNotNull()), digits), F.lit(0))
    out = F.coalesce(whole_quotient(x, y), out)
    return F.when((x < 0) != (y < 0), -out).otherwise(out).try_cast(DEC)


arithmetic("plus", lambda x, y: F.coalesce(F.try_add(x.try_cast(PLACES), y.try_cast(PLACES)).try_cast(DEC), cut18(F.try_add(x, y))), lambda x, y: x + y)
arithmetic("subtract", lambda x, y: F.coalesce(F.try_subtract(x.try_cast(PLACES), y.try_cast(PLACES)).try_cast(DEC), cut18(F.try_subtract(x, y))), lambda x, y: x - y)
arithmetic("multiply", lambda x, y: F.coalesce(product(x, y).try_cast(DEC), cut18(F.try_multiply(x, y))), lambda x, y: x * y)
arithmetic("divide", quotient, lambda x, y: F.when(y != 0, F.try_divide(x, y)).when(x == 0, float("nan")).when(x > 0, float("inf")).otherwise(float("-inf")))


@fn("unary-minus")
def minus(a: Column) -> Column:
    return numeric(-of(a, "num"), -of(a, "dec"), F.when(of(a, "dt").isin(WHOLE), XSD + "integer").otherwise(of(a, "dt")))


@fn("unary-plus")
def plus(a: Column) -> Column:
    return F.when(is_number(a), a)


def test(op: str) -> Fn:
    return lambda a, b: boolean(compare(a, b, op))


for _name, _op in (("less-than", "<"), ("less-than-or-equal", "<="), ("greater-than", ">"), ("greater-than-or-equal", ">=")):
    FUNCTIONS[_name] = test(_op)


def equal(a: Column, b: Column) -> Column:
    """Values if they compare, else terms; unequal literals of unknown types are an error."""
    same = of(a, "k") == of(b, "k")
    value = F.when(of(a, "dt").isin(XSD_STRING, LANG_STRING, DIR_STRING), same).otherwise(compare(a, b, "="))
    known = ~((of(a, "kind") == "L") & (of(b, "kind") == "L")) | is_text(a) & is_text(b)
    return F.when(same, True).otherwise(F.coalesce(value, F.when(known, same)))


FUNCTIONS["equals"] = lambda a, b: boolean(equal(a, b))
FUNCTIONS["not-equals"] = lambda a, b: boolean(~equal(a, b))
FUNCTIONS["logical-and"] = lambda a, b: boolean(ebv(a) & ebv(b))
FUNCTIONS["logical-or"] = lambda a, b: boolean(ebv(a) | ebv(b))
FUNCTIONS["logical-not"] = lambda a: boolean(~ebv(a))
FUNCTIONS["sameterm"] = FUNCTIONS["samevalue"] = lambda a, b: boolean(of(a, "k") == of(b, "k"))
FUNCTIONS["if"] = lambda c, a, b: F.when(ebv(c), a).when(~ebv(c), b)
FUNCTIONS["coalesce"] = lambda *a: F.coalesce(*a)
FUNCTIONS["bound"] = lambda a: boolean(a.isNotNull())

# -- terms
FUNCTIONS["isiri"] = FUNCTIONS["isuri"] = lambda a: boolean(of(a, "kind") == "I")
FUNCTIONS["isblank"] = lambda a: boolean(of(a, "kind") == "B")
FUNCTIONS["isliteral"] = lambda a: boolean(of(a, "kind") == "L")
FUNCTIONS["istriple"] = lambda a: boolean(of(a, "kind") == "T")
FUNCTIONS["isnumeric"] = lambda a: boolean(F.when(of(a, "kind").isNotNull(), is_number(a)))
FUNCTIONS["haslang"] = lambda a, r=None: boolean(F.when(of(a, "kind").isNotNull(), of(a, "lang").isNotNull()))
FUNCTIONS["haslangdir"] = lambda a: boolean(F.when(of(a, "kind").isNotNull(), of(a, "dir").isNotNull()))
FUNCTIONS["str"] = lambda a: string(F.when(of(a, "kind").isin("I", "L"), lex(a)))
FUNCTIONS["lang"] = lambda a: string(F.when(of(a, "kind") == "L", F.coalesce(of(a, "lang"), F.lit(""))))
FUNCTIONS["langdir"] = lambda a: string(F.when(of(a, "kind") == "L", F.coalesce(of(a, "dir"), F.lit(""))))
FUNCTIONS["datatype"] = lambda a: iri(of(a, "dt"))
FUNCTIONS["iri"] = FUNCTIONS["uri"] = lambda a: F.when(of(a, "kind") == "I", a).otherwise(iri(F.when(of(a, "dt") == XSD_STRING, lex(a))))
FUNCTIONS["bnode"] = lambda a=None: term_of_key(F.concat(F.lit("_:q"), F.replace(F.uuid(), F.lit("-"), F.lit(""))) if a is None else F.concat(F.lit("_:q"), F.md5(lex(a))))
FUNCTIONS["uuid"] = lambda: iri(F.concat(F.lit("urn:uuid:"), F.uuid()))
FUNCTIONS["struuid"] = lambda: string(F.uuid())
FUNCTIONS["strdt"] = lambda a, d: term_of_key(F.when(of(a, "dt") == XSD_STRING, F.concat(F.lit('"'), escaped(lex(a)), F.when(lex(d) == XSD_STRING, '"').otherwise(F.concat(F.lit('"^^<'), lex(d), F.lit(">"))))))
FUNCTIONS["strlang"] = lambda a, t: term_of_key(F.when(of(a, "dt") == XSD_STRING, F.concat(F.lit('"'), escaped(lex(a)), F.lit('"@'), F.lower(lex(t)))))
FUNCTIONS["strlangdir"] = lambda a, t, d: term_of_key(F.when(of(a, "dt") == XSD_STRING, F.concat(F.lit('"'), escaped(lex(a)), F.lit('"@'), F.lower(lex(t)), F.lit("--"), lex(d))))
FUNCTIONS["triple"] = lambda s, p, o: term_of_key(F.concat(F.lit("<<( "), of(s, "k"), F.lit(" "), of(p, "k"), F.lit(" "), of(o, "k"), F.lit(" )>>")))
_TRIPLE = r'^<<\( (\S+) (<[^>]*>) ((?s:.*)) \)>>$'
for _i, _name in enumerate(("subject", "predicate", "object")):
    FUNCTIONS[_name] = lambda a, i=_i: term_of_key(F.when(of(a, "kind") == "T", F.regexp_extract(of(a, "k"), _TRIPLE, i + 1)))

# -- strings
FUNCTIONS["strlen"] = lambda a: integer(F.char_length(text(a)))
FUNCTIONS["ucase"] = lambda a: like(F.upper(text(a)), a)
FUNCTIONS["lcase"] = lambda a: like(F.lower(text(a)), a)
FUNCTIONS["contains"] = lambda a, b: boolean(F.contains(text(a), text(b)))
FUNCTIONS["strstarts"] = lambda a, b: boolean(F.startswith(text(a), text(b)))
FUNCTIONS["strends"] = lambda a, b: boolean(F.endswith(text(a), text(b)))
FUNCTIONS["langmatches"] = lambda a, r: boolean(F.when(lex(r) == "*", lex(a) != "").otherwise((F.lower(lex(a)) == F.lower(lex(r))) | F.startswith(F.lower(lex(a)), F.concat(F.lower(lex(r)), F.lit("-")))))


@fn("strbefore")
def before(a: Column, b: Column) -> Column:
    at = F.position(text(b), text(a))
    return F.when(at > 0, like(F.substring(text(a), F.lit(1), at - 1), a)).when(at == 0, string(F.lit("")))


@fn("strafter")
def after(a: Column, b: Column) -> Column:
    at = F.position(text(b), text(a))
    return F.when(at > 0, like(F.substring(text(a), at + F.char_length(text(b)), F.char_length(text(a))), a)).when(at == 0, string(F.lit("")))


@fn("substr")
def substr(a: Column, start: Column, n: Column | None = None) -> Column:
    begin = F.floor(of(start, "num") + 0.5).cast("int")
    end = begin + F.floor(of(n, "num") + 0.5).cast("int") if n is not None else F.char_length(text(a)) + 1
    first = F.greatest(begin, F.lit(1))
    return like(F.substring(text(a), first, F.greatest(end - first, F.lit(0))), a)


@fn("concat")
def concat(*a: Column) -> Column:
    if not a:
        return string(F.lit(""))
    out = F.concat(*[text(x) for x in a])
    same = F.lit(True)
    for x in a[1:]:
        same = same & of(x, "lang").eqNullSafe(of(a[0], "lang")) & of(x, "dir").eqNullSafe(of(a[0], "dir"))
    return F.when(same, like(out, a[0])).otherwise(string(out))


@fn("encode", "encode_for_uri")
def encode(a: Column) -> Column:
    return string(F.replace(F.replace(F.replace(F.url_encode(text(a)), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def pattern_of(p: Column, flags: Column | None) -> Column:
    """For Java, when pattern and flags are data: '$' stays Java's but for lines' ends."""
    f = F.lit("dU") if flags is None else F.concat(F.lit("dU"), F.regexp_replace(lex(flags), "[^ismx]", ""))
    quoted = F.lit(False) if flags is None else F.contains(lex(flags), F.lit("q"))
    body = F.regexp_replace(lex(p), r"(?<!\\)\$$", r"\\z")
    return F.concat(F.lit("(?"), f, F.lit(")"), F.when(quoted, F.concat(F.lit("\\Q"), lex(p), F.lit("\\E"))).otherwise(body))


@fn("regex")
def regex(a: Column, p: Column, flags: Column | None = None) -> Column:
    return boolean(F.regexp(text(a), pattern_of(p, flags)))


@fn("replace")
def replace(a: Column, p: Column, by: Column, flags: Column | None = None) -> Column:
    return like(F.regexp_replace(text(a), pattern_of(p, flags), lex(by)), a)


for _name, _make in (("md5", F.md5), ("sha1", F.sha1), ("sha256", lambda x: F.sha2(x, 256)), ("sha384", lambda x: F.sha2(x, 384)), ("sha512", lambda x: F.sha2(x, 512))):
    FUNCTIONS[_name] = lambda a, f=_make: string(f(text(a).cast("binary")))

# -- numbers


def rounded(f: Callable[[Column], Column]) -> Fn:
    def g(a: Column) -> Column:
        dt = F.when(of(a, "dt").isin(WHOLE), XSD + "integer").otherwise(of(a, "dt"))
        return numeric(f(of(a, "num")).cast("double"), f(of(a, "dec")).try_cast(DEC), dt)

    return g


FUNCTIONS["abs"] = rounded(F.abs)
FUNCTIONS["ceil"] = rounded(F.ceil)
FUNCTIONS["floor"] = rounded(F.floor)
FUNCTIONS["round"] = rounded(lambda x: F.floor(x + F.lit("0.5").cast("decimal(2,1)")))
FUNCTIONS["rand"] = lambda: numeric(F.rand(), null(DEC), F.lit(XSD + "double"))

# -- dates and times


@fn("now")
def now() -> Column:
    body = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return typed(body, F.lit(XSD + "dateTime"), ts=F.current_timestamp(), tz=F.lit(True))


def piece(pattern: str, whole: bool = True) -> Fn:
    def g(a: Column) -> Column:
        ok = of(a, "dt").isin(XSD + "dateTime", XSD + "date", XSD + "time", XSD + "dateTimeStamp")
        x = F.when(ok, F.regexp_extract(lex(a), pattern, 1))
        x = F.when(x != "", x)
        return integer(x.try_cast("decimal(38,0)")) if whole else typed(F.regexp_replace(x, r"^0(?=[0-9])", ""), F.lit(XSD + "decimal"), number(x), x.try_cast(DEC))

    return g


FUNCTIONS["year"] = piece(r"^(-?[0-9]{4,})-")
FUNCTIONS["month"] = piece(r"^-?[0-9]{4,}-([0-9]{2})")
FUNCTIONS["day"] = piece(r"^-?[0-9]{4,}-[0-9]{2}-([0-9]{2})")
FUNCTIONS["hours"] = piece(r"(?:^|T)([0-9]{2}):[0-9]{2}:")
FUNCTIONS["minutes"] = piece(r"(?:^|T)[0-9]{2}:([0-9]{2}):")
FUNCTIONS["seconds"] = piece(r"(?:^|T)[0-9]{2}:[0-9]{2}:([0-9]{2}(?:\.[0-9]+)?)", whole=False)


def zone_text(a: Column) -> Column:
    ok = of(a, "dt").isin(XSD + "dateTime", XSD + "date", XSD + "time", XSD + "dateTimeStamp")
    return F.when(ok, F.regexp_extract(lex(a), r"[0-9](Z|[+-][0-9]{2}:[0-9]{2})$", 1))


FUNCTIONS["tz"] = lambda a: string(zone_text(a))


@fn("timezone")
def timezone(a: Column) -> Column:
    z = zone_text(a)
    h, m = F.substring(z, 2, 2).try_cast("int"), F.substring(z, 5, 2).try_cast("int")
    body = F.concat(F.when(z.startswith("-"), "-").otherwise(""), F.lit("PT"), F.when(h > 0, F.concat(h.cast("string"), F.lit("H"))).otherwise(""), F.when(m > 0, F.concat(m.cast("string"), F.lit("M"))).otherwise(""))
    return typed(F.when(z == "Z", "PT0S").when(z != "", F.when((h == 0) & (m == 0), "PT0S").otherwise(body)), F.lit(XSD + "dayTimeDuration"))


def cast_to(dt: str) -> Fn:
    """xsd:integer(x) and its like."""

    def g(a: Column) -> Column:
        src = lex(a)
        if dt == XSD_STRING:
            return string(F.when(of(a, "kind").isin("I", "L"), src))
        if dt == XSD + "boolean":
            return boolean(F.when(is_number(a), of(a, "num") != 0).when(src.isin("true", "1"), True).when(src.isin("false", "0"), False))
        if dt in WHOLE:
            return integer(F.when(is_number(a), F.when(of(a, "num") < 0, F.ceil(of(a, "num"))).otherwise(F.floor(of(a, "num")))).otherwise(F.when(full(src, r"[+-]?[0-9]+"), src.try_cast("decimal(38,0)"))))
        if dt == XSD + "decimal":
            d = F.coalesce(of(a, "dec"), of(a, "num").try_cast(DEC), F.when(full(src, LEXICAL["decimal"]), src.try_cast(DEC)))
            return numeric(null("double"), d, F.lit(dt))
        if dt in (XSD + "double", XSD + "float"):
            return numeric(F.coalesce(of(a, "num"), number(src)), null(DEC), F.lit(dt))
        if dt == XSD + "date":
            body = F.regexp_replace(src, "T[0-9:.]+", "")
            return typed(F.when(well_formed(body, dt), body), F.lit(dt), ts=stamp(body, F.lit(dt)), tz=of(a, "tz"))
        if dt == XSD + "dateTime":
            body = F.when(of(a, "dt") == XSD + "date", F.regexp_replace(src, r"^(-?[0-9]{4,}-[0-9]{2}-[0-9]{2})", "$1T00:00:00")).otherwise(src)
            return typed(F.when(well_formed(body, dt), body), F.lit(dt), ts=stamp(body, F.lit(dt)), tz=F.coalesce(of(a, "tz"), F.lit(False)))
        return typed(F.when(well_formed(src, dt), src), F.lit(dt))

    return g


def call(name: str, args: list[Column]) -> Column:
    """A function by its local name, or a cast by its datatype IRI."""
    if name.startswith(XSD):
        return cast_to(name)(*args)
    f = FUNCTIONS.get(name.lower())
    if f is None:
        raise KeyError(name)
    return f(*args)

