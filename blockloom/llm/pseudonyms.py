"""Format-preserving pseudonyms for personal numbers and dates, in SQL expressions only.

Each candidate in a text is validated (Luhn sums, IBAN check digits, octets, calendar, numbering
plans) and mapped to a number in a domain of known size a * b. A keyed Feistel network over
Z_a x Z_b, with SHA-256 as its round function, permutes the domain; the result is written back
in the candidate's own format, with valid check digits. The permutation has no table and no
state, so equal values get equal pseudonyms in all documents, and different ones stay different.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blockloom.llm.common import unused

ROUNDS = 8
KEY = "blockloom-demo-key"  # a parameter; production passes its own secret
FIRST_DAY, DAYS = "1900-01-01", 73049  # the days of the years 1900 to 2099
WALK = 121  # 271 * 270 - DAYS: points outside the calendar, and so the longest walk through them

# Candidate patterns by kind; every one begins where a token begins, so that a scan stays linear.
CANDIDATES = {
    "email": r"(?<![\w.%+-])[\w.%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+)+",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}+(?: ?[A-Z0-9]{1,3}+)?(?!\w)",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "iso": r"(?<![\w-])(?:19|20)\d\d-\d\d-\d\d(?![\w-])",
    "date": r"(?<![\w./])\d{1,2}([./])\d{1,2}\1(?:19|20)\d\d(?![\w/])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w(+.-])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\)[ .-]?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?![\w-])",
    "written": r"(?<![\w(+.-])\+1[ .-]?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?![\w-])",
    "world": r"(?<![\w+])\+[2-9]\d?(?:[ .-]?\d){7,12}+(?!\w)",
    "card": r"(?<![\w.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-]|\.\d)",
}
NUMBER = "|".join(f"(?:{p})" for p in CANDIDATES.values()).replace(r"\1", r"[./]")


def let(value: str, name: str, body: str) -> str:
    """`body` with `name` bound to `value`, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def feistel(value: str, a: str, b: str, kind: str, key: str) -> str:
    """Keyed permutation of 0 .. a * b - 1 as a SQL expression over bigint expressions."""
    secret = _literal(f"{key}|{kind}|")
    noise = lambda half: f"cast(conv(substring(sha2(concat({secret}, i, '|', {half}, '|', {a}, '|', {b}), 256), 1, 13), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('x', ({value}) div ({b}), 'y', ({value}) % ({b})), "
        f"(s, i) -> if(i % 2 = 1, named_struct('x', (s.x + {noise('s.y')}) % ({a}), 'y', s.y), named_struct('x', s.x, 'y', (s.y + {noise('s.x')}) % ({b}))), "
        f"s -> s.x * ({b}) + s.y)"
    )


def _ten(n: str) -> str:
    return f"cast(rpad('1', ({n}) + 1, '0') as bigint)"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _permuted_digits(digits: str, kind: str, key: str) -> str:
    """A string of 2 to 18 digits, permuted among those of its length."""
    core = feistel("cast(dd as bigint)", _ten("length(dd) div 2"), _ten("length(dd) - length(dd) div 2"), kind, key)
    return let(digits, "dd", f"lpad(cast({core} as string), length(dd), '0')")


def _refill(x: str, digits: str) -> str:
    """`x` with its digits replaced, from left to right, by those of `digits`."""
    walk = (
        "aggregate(split({x}, ''), named_struct('o', '', 'k', 1), "
        "(s, c) -> if(c between '0' and '9' and length(c) = 1, named_struct('o', s.o || substring(new, s.k, 1), 'k', s.k + 1), named_struct('o', s.o || c, 'k', s.k)), s -> s.o)"
    ).format(x=x)
    return let(digits, "new", walk)


def _luhn(digits: str) -> str:
    """Luhn sum of a digit string, its last digit counted once."""
    d = "cast(substring(ld, i, 1) as int)"
    return let(digits, "ld", f"aggregate(sequence(1, length(ld)), 0L, (s, i) -> s + if((length(ld) - i) % 2 = 1, (2 * {d}) div 10 + (2 * {d}) % 10, {d}))")


def _card(x: str, key: str) -> str:
    fresh = _permuted_digits("substring(cd, 1, length(cd) - 1)", "card", key)
    whole = let(fresh, "np", f"np || cast((10 - {_luhn('np || 0')} % 10) % 10 as string)")
    return let(_digits(x), "cd", f"if({_luhn('cd')} % 10 = 0, {_refill(x, whole)}, {x})")


def _mod97(text: str) -> str:
    """Remainder by 97 of digits and letters (A is 10 .. Z is 35)."""
    return f"aggregate(split({text}, ''), 0, (s, c) -> if(c = '', s, if(c between '0' and '9', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97)))"


def _iban(x: str, key: str) -> str:
    country = f"substring({x}, 1, 2)"
    bare = f"replace({x}, ' ', '')"
    digits = _digits("substring(ib, 5)")
    parts = let(
        digits, "bd",
        "if(length(bd) < 2, bd, if(length(bd) <= 18, {one}, {first} || if(length(bd) - 18 < 2, substring(bd, 19), {second})))".format(
            one=_permuted_digits("bd", "iban", key), first=_permuted_digits("substring(bd, 1, 18)", "iban", key), second=_permuted_digits("substring(bd, 19)", "iban2", key)
        ),
    )
    body = let(parts, "nd", _refill("substring(ib, 5)", "nd"))
    check = let(body, "nb", f"lpad(cast(98 - {_mod97(f'concat(nb, {country}, 0, 0)')} as string), 2, '0') || {_digits('nb')}")
    valid = f"{_mod97(f'concat(substring(ib, 5), substring(ib, 1, 4))')} = 1"
    return let(bare, "ib", f"if({valid}, {_refill(x, check)}, {x})")


def _ip(x: str, key: str) -> str:
    value = f"aggregate(split({x}, '[.]'), 0L, (s, o) -> s * 256 + cast(o as bigint))"
    new = let(value, "ip", feistel("ip", "65536L", "65536L", "ip", key))
    return let(new, "v", "concat_ws('.', v div 16777216, v div 65536 % 256, v div 256 % 256, v % 256)")


def _day(day: str, key: str) -> str:
    """Pseudonym of a day number counted from FIRST_DAY: the network permutes a few more points than
    there are days, and steps out of the calendar are followed until they lead back."""
    step = feistel("w", "271L", "270L", "date", key)
    return f"aggregate(sequence(1, {WALK + 1}), cast({day} as bigint), (w, j) -> if(j = 1 or w >= {DAYS}, {step}, w))"


def _dated(x: str, parts: str, order: str, key: str) -> str:
    """`parts`: year, month and day of `x` as an array expression; `order`: their new digits in the format of x."""
    ymd = "lpad(p[0], 4, '0') || '-' || lpad(p[1], 2, '0') || '-' || lpad(p[2], 2, '0')"
    new = let(f"date_add(date'{FIRST_DAY}', cast({_day('d', key)} as int))", "n", order)
    return let(parts, "p", let(f"datediff(cast(try_to_timestamp({ymd}, 'yyyy-MM-dd') as date), date'{FIRST_DAY}')", "d", f"if(d is null or d < 0 or d >= {DAYS}, {x}, {new})"))


def _date(x: str, key: str) -> str:
    mark = f"if(instr({x}, '/') > 0, '/', '.')"
    return let(
        f"split({x}, '[./]')", "q",
        let(
            "cast(q[1] as int) > 12", "us",  # month first, as only then the date exists
            _dated(x, "if(us, array(q[2], q[0], q[1]), array(q[2], q[1], q[0]))",
                   f"concat_ws({mark}, lpad(if(us, month(n), day(n)), 2, '0'), lpad(if(us, day(n), month(n)), 2, '0'), cast(year(n) as string))", key),
        ),
    )


def _ssn(x: str, key: str) -> str:
    d = _digits(x)
    area, group, serial = "cast(substring(sd, 1, 3) as bigint)", "cast(substring(sd, 4, 2) as bigint)", "cast(substring(sd, 6, 4) as bigint)"
    number = f"(({area} - 1 - if({area} > 666, 1, 0)) * 99 + {group} - 1) * 9999 + {serial} - 1"
    new = let(feistel("sv", "88902L", "9999L", "ssn", key), "n", let("n div 989901 + 1", "ar", "concat(lpad(ar + if(ar >= 666, 1, 0), 3, '0'), '-', lpad(n div 9999 % 99 + 1, 2, '0'), '-', lpad(n % 9999 + 1, 4, '0'))"))
    valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
    return let(d, "sd", f"if({valid}, {let(number, 'sv', new)}, {x})")


def _phone(x: str, key: str) -> str:
    core = "right(pd, 10)"
    number = f"(cast(substring({core}, 1, 3) as bigint) - 200) * 8000000 + (cast(substring({core}, 4, 3) as bigint) - 200) * 10000 + cast(substring({core}, 7, 4) as bigint)"
    new = let(let(number, "pv", feistel("pv", "80000L", "80000L", "phone", key)), "n", "concat(substring(pd, 1, length(pd) - 10), n div 8000000 + 200, n div 10000 % 800 + 200, lpad(n % 10000, 4, '0'))")
    return let(_digits(x), "pd", _refill(x, new))


def _written(x: str, key: str) -> str:
    """A number written as a phone whose area code or exchange begins with 0 or 1: permuted among the
    3.6e9 such numbers, so that it never takes the pseudonym of a number of the plan."""
    area, exchange = "cast(substring(wd, 2, 3) as bigint)", "cast(substring(wd, 5, 3) as bigint)"
    serial = "cast(right(wd, 4) as bigint)"
    number = f"if({area} < 200, {area} * 10000000 + {exchange} * 10000, 2000000000L + ({area} - 200) * 2000000 + {exchange} * 10000) + {serial}"
    text = "if(n < 2000000000L, lpad(n, 10, '0'), concat((n - 2000000000L) div 2000000 + 200, lpad((n - 2000000000L) div 10000 % 200, 3, '0'), lpad(n % 10000, 4, '0')))"
    new = let(let(number, "pv", feistel("pv", "60000L", "60000L", "written", key)), "n", f"concat('1', {text})")
    return let(_digits(x), "wd", _refill(x, new))


def _world(x: str, key: str) -> str:
    return let(_digits(x), "wd", _refill(x, f"substring(wd, 1, 2) || {_permuted_digits('substring(wd, 3)', 'world', key)}"))


def _email(x: str, key: str) -> str:
    """The mailbox: each run of letters and digits, in parts of up to 11, is a number in base 36."""
    part = let(
        "lower(e)", "lo",
        let("cast(conv(lo, 36, 10) as bigint)", "v",
            let("cast(rpad('1', length(lo) div 2 + 1, '0') as string)", "ha",
                let("cast(rpad('1', length(lo) - length(lo) div 2 + 1, '0') as string)", "hb",
                    f"lpad(lower(conv(cast({feistel('v', 'cast(conv(ha, 36, 10) as bigint)', 'cast(conv(hb, 36, 10) as bigint)', 'email', key)} as string), 10, 36)), length(lo), '0')"))),
    )
    box = f"substring_index({x}, '@', 1)"
    runs = f"regexp_extract_all({box}, '[A-Za-z0-9]{{1,11}}|[^A-Za-z0-9]+', 0)"
    return f"concat(array_join(transform({runs}, e -> if(e rlike '^[A-Za-z0-9]', {part}, e)), ''), '@', substring_index({x}, '@', -1))"


def pseudonym(x: str, key: str = KEY) -> str:
    """SQL expression for the pseudonym of one candidate `x`; an invalid candidate stays as it is."""
    rule = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "written": _written, "world": _world, "card": _card}
    rule["iso"] = lambda x, k: _dated(x, f"split({x}, '-')", "date_format(n, 'yyyy-MM-dd')", k)
    kind = " ".join(f"when {x} rlike {_literal('^(?:' + p + ')$')} then {rule[k](x, key)}" for k, p in CANDIDATES.items())
    return f"case {kind} else {x} end"


def pseudonymise(docs: DataFrame, text_col: str = "text", key: str = KEY, found_col: str | None = None) -> DataFrame:
    """`docs` with all valid candidates in `text_col` replaced by their pseudonyms; `found_col`, if
    given, counts them. A null text stays null, an empty one empty; other columns, whatever their
    names, null ids and repeated rows are carried along; an empty table gives an empty result. Values that fail their check are left alone, so that order
    numbers and measurements keep their meaning.
    """
    pattern = _literal(NUMBER)
    plain, fresh = unused(docs, "plain"), unused(docs, "fresh")
    found = f"regexp_extract_all({plain}, {pattern}, 0)"
    new = f"transform({found}, x -> {pseudonym('x', key)})"
    named = docs.withColumn(plain, F.col(text_col).cast("string"))
    named = named.withColumn(fresh, F.expr(f"if({plain} rlike '[0-9@]', {new}, cast(array() as array<string>))"))
    joined = F.expr(f"if(size({fresh}) = 0, {plain}, array_join(flatten(zip_with(split({plain}, {pattern}, -1), {fresh}, (g, m) -> if(m is null, array(g), array(g, m)))), ''))")
    out = named.withColumn(text_col, joined)
    if found_col:
        changed = F.expr(f"if(size({fresh}) = 0, 0, size(filter(zip_with({found}, {fresh}, (o, m) -> o <> m), t -> t)))").cast("bigint")
        out = out.withColumn(found_col, changed)
    return out.drop(plain, fresh)


def op1_pseudonyms(spark, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), found_col="n_replaced")
