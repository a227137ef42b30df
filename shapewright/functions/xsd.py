"""XSD value semantics as Column expressions over the fields of a term."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..terms import DIR_STRING, LANG_STRING, XSD, XSD_STRING, Parts, parts

# A term in a DataFrame. num, dec, ts and tz are what its value compares by; null where it has no such value.
TERM = T.StructType(
    [
        T.StructField("k", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("lex", T.StringType()),
        T.StructField("dt", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("dir", T.StringType()),
        T.StructField("num", T.DoubleType()),
        T.StructField("dec", T.DecimalType(38, 18)),
        T.StructField("ts", T.TimestampType()),
        T.StructField("tz", T.BooleanType()),
    ]
)
FIELDS = [f.name for f in TERM]
DEC = "decimal(38,18)"

# Integer types with their least and greatest values.
INTEGERS: dict[str, tuple[int | None, int | None]] = {
    "integer": (None, None),
    "nonNegativeInteger": (0, None),
    "positiveInteger": (1, None),
    "nonPositiveInteger": (None, 0),
    "negativeInteger": (None, -1),
    "long": (-(2**63), 2**63 - 1),
    "int": (-(2**31), 2**31 - 1),
    "short": (-(2**15), 2**15 - 1),
    "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1),
    "unsignedInt": (0, 2**32 - 1),
    "unsignedShort": (0, 2**16 - 1),
    "unsignedByte": (0, 255),
}
ZONE = r"(Z|[+-](0[0-9]|1[0-3]):[0-5][0-9]|[+-]14:00)?"
YEAR = r"-?([1-9][0-9]{3,}|0[0-9]{3})"
DAY = r"(0[1-9]|[12][0-9]|3[01])"
MONTH = r"(0[1-9]|1[0-2])"
CLOCK = r"(([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?|24:00:00(\.0+)?)"
DURATION = r"-?P((([0-9]+Y([0-9]+M)?([0-9]+D)?|[0-9]+M([0-9]+D)?|[0-9]+D)(T([0-9]+H([0-9]+M)?([0-9]+(\.[0-9]+)?S)?|[0-9]+M([0-9]+(\.[0-9]+)?S)?|[0-9]+(\.[0-9]+)?S))?)|(T([0-9]+H([0-9]+M)?([0-9]+(\.[0-9]+)?S)?|[0-9]+M([0-9]+(\.[0-9]+)?S)?|[0-9]+(\.[0-9]+)?S)))"
# Lexical forms.
LEXICAL = {
    "boolean": r"true|false|1|0",
    "decimal": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)",
    "float": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "double": r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?|[+-]?INF|NaN",
    "dateTime": f"{YEAR}-{MONTH}-{DAY}T{CLOCK}{ZONE}",
    "dateTimeStamp": f"{YEAR}-{MONTH}-{DAY}T{CLOCK}{ZONE[:-1]}",
    "date": f"{YEAR}-{MONTH}-{DAY}{ZONE}",
    "time": f"{CLOCK}{ZONE}",
    "duration": DURATION,
    "dayTimeDuration": r"-?P(([0-9]+D)(T([0-9]+H([0-9]+M)?([0-9]+(\.[0-9]+)?S)?|[0-9]+M([0-9]+(\.[0-9]+)?S)?|[0-9]+(\.[0-9]+)?S))?|(T([0-9]+H([0-9]+M)?([0-9]+(\.[0-9]+)?S)?|[0-9]+M([0-9]+(\.[0-9]+)?S)?|[0-9]+(\.[0-9]+)?S)))",
    "yearMonthDuration": r"-?P([0-9]+Y([0-9]+M)?|[0-9]+M)",
    "gYear": f"{YEAR}{ZONE}",
    "gYearMonth": f"{YEAR}-{MONTH}{ZONE}",
    "gMonth": f"--{MONTH}{ZONE}",
    "gDay": f"---{DAY}{ZONE}",
    "gMonthDay": f"--(02-(0[1-9]|[12][0-9])|(0[469]|11)-(0[1-9]|[12][0-9]|30)|(0[13578]|1[02])-{DAY}){ZONE}",
    "hexBinary": r"([0-9a-fA-F]{2})*",
    "base64Binary": r"(([A-Za-z0-9+/] ?){4})*(([A-Za-z0-9+/] ?){3}[A-Za-z0-9+/]|([A-Za-z0-9+/] ?){2}[AEIMQUYcgkosw048] ?=|[A-Za-z0-9+/] ?[AQgw] ?= ?=)?",
}
NUMERIC = [XSD + x for x in (*INTEGERS, "decimal", "float", "double")]
EXACT = [XSD + x for x in (*INTEGERS, "decimal")]
STRINGS = [XSD_STRING, XSD + "anyURI", LANG_STRING, DIR_STRING]


def full(lex: Column, pattern: str) -> Column:
    return lex.rlike(rf"\A(?:{pattern})\z")


def well_formed(lex: Column, dt: str) -> Column:
    """Whether lex is a lexical form of the datatype; true for unknown ones."""
    name = dt.removeprefix(XSD) if dt.startswith(XSD) else ""
    if name in INTEGERS:
        low, high = INTEGERS[name]
        ok = full(lex, r"[+-]?[0-9]+")
        if low is not None or high is not None:
            digits = F.regexp_replace(F.regexp_replace(lex, r"^[+-]", ""), r"^0+(?=[0-9])", "")
            neg = lex.startswith("-") & (digits != "0")
            value = lex.try_cast("decimal(38,0)")
            big = F.length(digits) > 30
            checks = []
            if low is not None:
                checks.append(F.when(big, ~neg).otherwise(value >= F.lit(str(low)).cast("decimal(38,0)")))
            if high is not None:
                checks.append(F.when(big, neg).otherwise(value <= F.lit(str(high)).cast("decimal(38,0)")))
            for c in checks:
                ok = ok & F.coalesce(c, F.lit(False))
        return ok
    if name in LEXICAL:
        ok = full(lex, LEXICAL[name])
        if name in ("date", "dateTime", "dateTimeStamp"):
            # the day must be in the month
            day = F.regexp_extract(lex, r"^-?([0-9]+-[0-9]{2}-[0-9]{2})", 1)
            ok = ok & (F.when(F.length(day) == 10, F.when(day.startswith("0000"), F.lit(True)).otherwise(day.try_cast("date").isNotNull())).otherwise(F.lit(True)))
        return ok
    return F.lit(True)


def number(lex: Column) -> Column:
    """The double of a lexical form of a numeric type; null if there is none."""
    plain = F.when(full(lex, LEXICAL["double"]), lex)
    return F.when(plain.endswith("INF"), F.when(plain.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).otherwise(F.regexp_replace(plain, r"\.$", ".0").try_cast("double"))


def stamp(lex: Column, dt: Column) -> Column:
    """The instant of a dateTime, or of the start of a date, as UTC; no zone counts as UTC. Null if there is none."""
    body = F.regexp_replace(lex, r"(Z|[+-][0-9]{2}:[0-9]{2})$", "")
    zone = F.regexp_extract(lex, r"(Z|[+-][0-9]{2}:[0-9]{2})$", 1)
    local = F.when(dt == XSD + "date", F.concat(F.regexp_replace(lex, r"(?<=[0-9]{2}-[0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})$", ""), F.lit("T00:00:00"))).otherwise(body)
    zone = F.when((dt == XSD + "date") & ~lex.rlike(r"[0-9]-[0-9]{2}-[0-9]{2}(Z|[+-][0-9]{2}:[0-9]{2})$"), "").otherwise(zone)
    return F.concat(F.regexp_replace(local, "T24:00:00(\\.0+)?", "T23:59:59.999999"), F.when(zone == "", "Z").otherwise(zone)).try_cast("timestamp")


def has_zone(lex: Column) -> Column:
    return lex.rlike(r"[T:0-9](Z|[+-][0-9]{2}:[0-9]{2})$") & ~lex.rlike(r"^-?[0-9]{4,}-[0-9]{2}-[0-9]{2}$")


def let(values: list[Column], f: Callable[[list[Column]], Column]) -> Column:
    """f of the values, each of which is written out and worked out once, however often f uses it."""
    if not values:
        return f([])
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.get(F.transform(F.array(packed), lambda p: f([p.getField(f"v{i}") for i in range(len(values))])), F.lit(0))


def term(k: Column, kind: Column, lex: Column, dt: Column, lang: Column, dir_: Column, num: Column, dec: Column, ts: Column, tz: Column) -> Column:
    return F.struct(*[c.cast(f.dataType).alias(f.name) for c, f in zip((k, kind, lex, dt, lang, dir_, num, dec, ts, tz), TERM)])


def null(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def iri_term(k: Column) -> Column:
    return term(k, F.lit("I"), F.substring(k, F.lit(2), F.length(k) - 2), null(), null(), null(), null("double"), null(DEC), null("timestamp"), null("boolean"))


def literal_term(lex: Column, dt: str, native: Column | None = None) -> Column:
    """A typed literal of a non-null lexical form; native is its value as a Spark number or timestamp."""
    k = F.concat(F.lit('"'), escaped(lex) if dt == XSD_STRING else lex, F.lit('"' if dt == XSD_STRING else f'"^^<{dt}>'))
    num = ts = tz = None
    dec = None
    if dt in NUMERIC:
        num = native.cast("double") if native is not None else number(lex)
        dec = native.cast(DEC) if native is not None and dt in EXACT else lex.try_cast(DEC) if dt in EXACT else None
    if dt in (XSD + "dateTime", XSD + "date"):
        ts, tz = native if native is not None else stamp(lex, F.lit(dt)), F.lit(False) if native is not None else has_zone(lex)
    return term(k, F.lit("L"), lex, F.lit(dt), null(), null(), num if num is not None else null("double"), dec if dec is not None else null(DEC), ts if ts is not None else null("timestamp"), tz if tz is not None else null("boolean"))


def lang_term(lex: Column, lang: Column) -> Column:
    return term(F.concat(F.lit('"'), escaped(lex), F.lit('"@'), F.lower(lang)), F.lit("L"), lex, F.lit(LANG_STRING), F.lower(lang), null(), null("double"), null(DEC), null("timestamp"), null("boolean"))


def escaped(lex: Column) -> Column:
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
        lex = F.replace(lex, F.lit(a), F.lit(b))
    return lex


def unescaped(text: Column) -> Column:
    # between escaped backslashes, each part by itself
    whole = F.array_join(F.transform(F.split(text, r"\\\\"), unescaped_part), "\\")
    return F.when(text.contains("\\\\"), whole).otherwise(unescaped_part(text))


def unescaped_part(text: Column) -> Column:
    for a, b in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\b", "\b"), ("\\f", "\f"), ('\\"', '"')):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def term_of_key(k: Column) -> Column:
    """A term from its key; null for null."""
    body = F.regexp_extract(k, r'^"((?s:(?:[^"\\]|\\.)*))"', 1)
    tail = F.regexp_extract(k, r'^"(?s:(?:[^"\\]|\\.)*)"(.*)$', 1)

    def typed(v: list[Column]) -> Column:
        lex, tail = v
        dt = F.when(tail.startswith("^^"), F.regexp_extract(tail, r"^\^\^<(.*)>$", 1)).when(tail.contains("--"), F.lit(DIR_STRING)).when(tail.startswith("@"), F.lit(LANG_STRING)).otherwise(F.lit(XSD_STRING))
        lang = F.when(tail.startswith("@"), F.regexp_extract(tail, r"^@([A-Za-z0-9]+(?:-[A-Za-z0-9]+)*)", 1))
        direction = F.when(tail.contains("--"), F.regexp_extract(tail, r"--([a-z]+)$", 1))
        return let([lex, dt, lang, direction], valued)

    def valued(v: list[Column]) -> Column:
        lex, dt, lang, direction = v
        # only the test of the literal's own type is run
        good = stamped = F.when(F.lit(False), F.lit(False))
        for x in (*INTEGERS, "decimal", "float", "double"):
            good = good.when(dt == XSD + x, well_formed(lex, XSD + x))
        for x in ("dateTime", "date"):
            stamped = stamped.when(dt == XSD + x, well_formed(lex, XSD + x))
        return let([good, stamped], lambda w: term(k, F.lit("L"), lex, dt, lang, direction, F.when(w[0], number(lex)), F.when(w[0] & dt.isin(EXACT), lex.try_cast(DEC)), F.when(w[1], stamp(lex, dt)), F.when(w[1], has_zone(lex))))

    return F.when(k.startswith('"'), let([unescaped(body), tail], typed)).when(k.isNotNull(), node_term(k))


def node_term(k: Column) -> Column:
    """A term from the key of an IRI, blank node or triple term."""
    kind = F.when(k.startswith("<<("), "T").when(k.startswith("_:"), "B").otherwise("I")
    lex = F.when(k.startswith("<<("), k).when(k.startswith("_:"), F.substring(k, F.lit(3), F.length(k))).otherwise(F.substring(k, F.lit(2), F.length(k) - 2))
    return term(k, kind, lex, null(), null(), null(), null("double"), null(DEC), null("timestamp"), null("boolean"))


def term_row(key: str) -> tuple:
    """The fields of a known term, in Python."""
    import datetime
    import decimal
    import re

    p = parts(key)
    num = dec = ts = tz = None
    if p.dt in NUMERIC and re.fullmatch(LEXICAL["double"], p.lex) and valid(p.lex, p.dt):
        num = float(p.lex.replace("INF", "inf").replace("NaN", "nan"))
        if p.dt in EXACT and len(p.lex) < 38:
            try:
                dec = decimal.Decimal(p.lex).quantize(decimal.Decimal("1e-18"), context=decimal.Context(prec=38))
            except decimal.InvalidOperation:
                dec = None
    if p.dt in (XSD + "dateTime", XSD + "date") and valid(p.lex, p.dt):
        zone = re.search(r"(Z|[+-][0-9]{2}:[0-9]{2})$", p.lex if p.dt.endswith("Time") or len(p.lex) > 10 else "")
        body = p.lex[: zone.start()] if zone else p.lex
        try:
            ts = datetime.datetime.fromisoformat((body if "T" in body else body + "T00:00:00") + (zone[0].replace("Z", "+00:00") if zone else "+00:00"))
            tz = bool(zone)
        except ValueError:
            ts = tz = None
    return (key, p.kind, p.lex, p.dt, p.lang, p.dir, num, dec, ts, tz)


def valid(lex: str, dt: str) -> bool:
    """well_formed in Python."""
    import datetime
    import re

    name = dt.removeprefix(XSD)
    if name in INTEGERS:
        low, high = INTEGERS[name]
        return bool(re.fullmatch(r"[+-]?[0-9]+", lex)) and (low is None or int(lex) >= low) and (high is None or int(lex) <= high)
    if name in LEXICAL and dt.startswith(XSD):
        if not re.fullmatch(LEXICAL[name], lex):
            return False
        if name.startswith("date") and (m := re.match(r"([0-9]{4}-[0-9]{2}-[0-9]{2})", lex)) and m[1] > "0001":
            try:
                datetime.date.fromisoformat(m[1])
            except ValueError:
                return False
    return True


def constant(key: str) -> Column:
    """A known term: every field is a literal, so checks against it fold."""
    import datetime

    p: Parts = parts(key)
    num = dec = ts = tz = None
    if p.dt in NUMERIC:
        import re

        if re.fullmatch(LEXICAL["double"], p.lex):
            num = float(p.lex.replace("INF", "inf"))
            if p.dt in EXACT:
                dec = F.lit(p.lex).cast(DEC)
    if p.dt in (XSD + "dateTime", XSD + "date"):
        try:
            d = datetime.datetime.fromisoformat(p.lex if p.dt.endswith("Time") else p.lex[:10])
            zoned = d.tzinfo is not None or (p.dt.endswith("date") and len(p.lex) > 10)
            ts, tz = stamp(F.lit(p.lex), F.lit(p.dt)), F.lit(zoned)
        except ValueError:
            pass
    return term(
        F.lit(key), F.lit(p.kind), F.lit(p.lex), F.lit(p.dt) if p.dt else null(), F.lit(p.lang) if p.lang else null(), F.lit(p.dir) if p.dir else null(),
        F.lit(num) if num is not None else null("double"), dec if dec is not None else null(DEC), ts if ts is not None else null("timestamp"), tz if tz is not None else null("boolean"),
    )


def compare(a: Column, b: Column, op: str) -> Column:
    """Three-valued `a op b` (<, <=, >, >=, =) of two terms by value; null if they can't be compared.

    Numbers compare exactly if both are, else as doubles; NaN with nothing. Instants with and without a zone compare
    only if they are at least 14 hours apart. Strings, booleans compare among themselves.
    """

    def test(x: Column, y: Column) -> Column:
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y}[op]

    def of(x: Column, f: str) -> Column:
        return x.getField(f)

    xn, yn = of(a, "num"), of(b, "num")
    num = F.when(xn.isNotNull() & yn.isNotNull() & ~F.isnan(xn) & ~F.isnan(yn), F.coalesce(test(of(a, "dec"), of(b, "dec")), test(xn, yn)))
    same = of(a, "dt") == of(b, "dt")
    near = F.abs(F.unix_micros(of(a, "ts")) - F.unix_micros(of(b, "ts"))) < 14 * 3600 * 1_000_000
    ts = F.when(same & ~((of(a, "tz") != of(b, "tz")) & near), test(of(a, "ts"), of(b, "ts")))
    text = F.when(of(a, "dt").isin(STRINGS) & of(b, "dt").isin(STRINGS), test(of(a, "lex"), of(b, "lex")))
    boolean = F.when(same & (of(a, "dt") == XSD + "boolean"), test(of(a, "lex").isin("true", "1"), of(b, "lex").isin("true", "1")))
    clock = F.when(same & (of(a, "dt") == XSD + "time"), test(of(a, "lex"), of(b, "lex")))
    return F.coalesce(num, ts, text, boolean, clock)


def language_matches(lang: Column, ranges: str | list[str]) -> Column:
    """RFC 4647 basic filtering of a tag by any of the ranges."""
    out = F.lit(False)
    for r in [ranges] if isinstance(ranges, str) else ranges:
        r = r.lower()
        out = out | (lang.isNotNull() & (F.lit(True) if r == "*" else (F.lower(lang) == r) | F.lower(lang).startswith(r + "-")))
    return F.coalesce(out, F.lit(False))
