"""Format-preserving pseudonyms of personal numbers and dates by a keyed Feistel network.

Values are found by one pattern and validated by kind. A valid value is ranked in the set of the
values that have its format, split into two numbers A < a and B < b whose product a * b is the size
of that set, and permuted: in turn A moves by a keyed function of B and B by one of A. What comes
out has the same format and is valid again; equal values get equal pseudonyms in all documents,
different values different ones, and who holds the key can go back. All of it is SQL over a row.

An address with leading zeros in a part has no single reading and is none.

Kinds: card (13 to 19 digits that pass the Luhn test; the first digit stays, the check digit
follows), phone, ssn, ip and date (yyyy-mm-dd; it stays in its century). E-mail addresses and hex
secrets (32 digits or more, in one case of letters) are no numbers: their names become keyed digests of the same kind, linked but one-way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: One alternative for each kind. Possessive runs and look-behind keep it linear in very long words.
PATTERN = "|".join(
    [
        r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-]{1,63}+(?:\.[A-Za-z0-9\-]{1,63}+){1,8}+",
        r"(?<![\p{L}\p{N}])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}.])\d{1,3}+(?:\.\d{1,3}+){3}+(?![\p{L}\p{N}]|\.\d)",
        r"(?<![\p{L}\p{N}\-])\d{4}-\d{2}-\d{2}(?![\p{L}\p{N}\-])",
        r"(?<![\p{L}\p{N}\-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
        r"(?<![\p{L}\p{N}])\+?\d{0,3}+ ?\(\d{3}\) ?\d{3}[\- .]\d{4}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}\-])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\p{L}\p{N}\-])",
        r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}+(?![\p{L}\p{N}])",
    ]
)


def _luhn_sum(digits: str) -> str:
    """SQL: the Luhn sum of a digit string; the last digit counts once."""
    return (
        f"aggregate(sequence(1, length({digits})), 0, (s, i) -> s + aggregate(array(cast(substr({digits}, length({digits}) + 1 - i, 1) as int)), 0, "
        f"(z, d) -> d * (1 + (i + 1) % 2) - if(d * (1 + (i + 1) % 2) > 9, 9, 0)))"
    )


def _steps(key: str, rounds: int, back: bool) -> list[str]:
    """SQL over ``hits`` (array of strings) that makes, one array after the other, the pseudonyms ``new``."""
    half = "conv(substr(sha2(concat_ws('|', '{key}', s.kind, s.ra, s.rb, i, {x}, '{key}'), 256), 1, 15), 16, 10)"
    f_of_b = f"cast({half.format(key=key, x='z.B')} as bigint) % s.ra"
    f_of_a = f"cast({half.format(key=key, x='z.A')} as bigint) % s.rb"
    order = f"sequence({rounds}, 1, -1)" if back else f"sequence(1, {rounds})"
    sign = "-" if back else "+"
    kind = """case
        when m like '%@%' then 'email'
        when m rlike '^([0-9a-f]{32,}|[0-9A-F]{32,})$' then if(m rlike '[0-9]', 'secret', null)
        when m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' then if(forall(split(m, '[.]'), o -> cast(o as int) < 256 and o rlike '^(0|[1-9][0-9]*)$'), 'ip', null)
        when m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' then if(try_to_timestamp(m, 'yyyy-MM-dd') is not null and substr(m, 1, 4) > '0000', 'date', null)
        when m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then if(substr(m, 1, 3) not in ('000', '666') and substr(m, 1, 1) <> '9' and substr(m, 5, 2) <> '00' and substr(m, 8) <> '0000', 'ssn', null)
        when m rlike '[0-9]{3}[)]? ?[.-]?[0-9]{3}[ .-][0-9]{4}$' and length(regexp_replace(m, '[^0-9]', '')) between 10 and 13 and m rlike '[(]|^[0-9]{3}[.-]' then 'phone'
        else 'card' end"""
    d = "s.d"
    century = "((cast(substr(s.m, 1, 4) as int) - 1) div 100)"
    day = f"datediff(to_date(s.m), make_date({century} * 100 + 1, 1, 1))"
    part = f"cast(substr({d}, 2, length({d}) - 2) as bigint)"
    width = f"((length({d}) - 2) div 2)"
    ten = "cast(power(10, {}) as bigint)"
    low = ten.format(width)
    area = "cast(substr(s.d, 1, 3) as int)"
    ssn = f"({area} - 1 - if({area} > 666, 1, 0)) * 99 + cast(substr(s.d, 4, 2) as int) - 1"
    ab = f"""case s.kind
        when 'card' then named_struct('A', {part} div {low}, 'B', {part} % {low}, 'ra', {ten.format(f"(length({d}) - 2 - {width})")}, 'rb', {low})
        when 'phone' then named_struct('A', cast(substr(right({d}, 10), 1, 5) as bigint), 'B', cast(right({d}, 5) as bigint), 'ra', 100000L, 'rb', 100000L)
        when 'ssn' then named_struct('A', cast({ssn} as bigint), 'B', cast(right({d}, 4) as bigint) - 1, 'ra', 88902L, 'rb', 9999L)
        when 'ip' then named_struct('A', cast(split(s.m, '[.]')[0] as bigint) * 256 + cast(split(s.m, '[.]')[1] as bigint), 'B', cast(split(s.m, '[.]')[2] as bigint) * 256 + cast(split(s.m, '[.]')[3] as bigint), 'ra', 65536L, 'rb', 65536L)
        when 'date' then named_struct('A', cast({day} as bigint) div if(({century} + 1) % 4 = 0, 75L, 92L), 'B', cast({day} as bigint) % if(({century} + 1) % 4 = 0, 75L, 92L), 'ra', if(({century} + 1) % 4 = 0, 487L, 397L), 'rb', if(({century} + 1) % 4 = 0, 75L, 92L))
        end"""
    # a permutation of the pairs (A, B), A < a, B < b
    forward = f"if(i % 2 = 1, named_struct('A', pmod(z.A {sign} {f_of_b}, s.ra), 'B', z.B), named_struct('A', z.A, 'B', pmod(z.B {sign} {f_of_a}, s.rb)))"
    moved = f"aggregate({order}, named_struct('A', s.A0, 'B', s.B0), (z, i) -> {forward})"
    free = "concat(substr(s.d, 1, 1), lpad(cast(s.z.A as string), length(cast(s.ra as string)) - 1, '0'), lpad(cast(s.z.B as string), length(cast(s.rb as string)) - 1, '0'))"
    luhn = _luhn_sum("concat(x, '0')")
    group, place = "(s.z.A % 99 + 1)", "(s.z.A div 99 + 1)"
    digits = f"""case s.kind
        when 'card' then aggregate(array({free}), '', (y, x) -> concat(x, cast((10 - {luhn} % 10) % 10 as string)))
        when 'phone' then concat(substr(s.d, 1, length(s.d) - 10), lpad(cast(s.z.A as string), 5, '0'), lpad(cast(s.z.B as string), 5, '0'))
        when 'ssn' then concat(lpad(cast({place} + if({place} >= 666, 1, 0) as string), 3, '0'), lpad(cast({group} as string), 2, '0'), lpad(cast(s.z.B + 1 as string), 4, '0'))
        end"""
    filled = "aggregate(split(s.m, ''), named_struct('o', '', 'k', 1), (z, c) -> if(c between '0' and '9', named_struct('o', concat(z.o, substr(s.n, z.k, 1)), 'k', z.k + 1), named_struct('o', concat(z.o, c), 'k', z.k)), z -> z.o)"
    digest = f"sha2(concat_ws('|', '{key}', s.kind, lower(s.m), '{key}'), 256)"
    # as many digests behind each other as the secret is long
    long = f"substr(array_join(transform(sequence(0, (length(s.m) - 1) div 64), k -> if(k = 0, {digest}, sha2(concat_ws('|', '{key}', s.kind, k, lower(s.m), '{key}'), 256))), ''), 1, length(s.m))"
    new = f"""case
        when s.kind is null then s.m
        when s.kind = 'email' then concat('u', substr({digest}, 1, 12), '@', substring_index(s.m, '@', -1))
        when s.kind = 'secret' then if(s.m rlike '[A-F]', upper({long}), {long})
        when s.kind = 'ip' then concat_ws('.', s.z.A div 256, s.z.A % 256, s.z.B div 256, s.z.B % 256)
        when s.kind = 'date' then date_format(date_add(make_date({century} * 100 + 1, 1, 1), cast(s.z.A * s.rb + s.z.B as int)), 'yyyy-MM-dd')
        else {filled} end"""
    valid = f"if(m.kind = 'card', if(length(m.d) between 13 and 19 and {_luhn_sum('m.d')} % 10 = 0, 'card', null), m.kind)"
    return [
        f"transform(hits, m -> named_struct('m', m, 'd', regexp_replace(m, '[^0-9]', ''), 'kind', {kind}))",
        f"transform(hits, m -> named_struct('m', m.m, 'd', m.d, 'kind', {valid}))",
        f"transform(hits, s -> named_struct('m', s.m, 'd', s.d, 'kind', s.kind, 'p', {ab}))",
        "transform(hits, s -> named_struct('m', s.m, 'd', s.d, 'kind', s.kind, 'A0', s.p.A, 'B0', s.p.B, 'ra', s.p.ra, 'rb', s.p.rb))",
        f"transform(hits, s -> named_struct('m', s.m, 'd', s.d, 'kind', s.kind, 'ra', s.ra, 'rb', s.rb, 'z', if(s.ra is null, null, {moved})))",
        f"transform(hits, s -> named_struct('m', s.m, 'd', s.d, 'kind', s.kind, 'ra', s.ra, 'rb', s.rb, 'z', s.z, 'n', {digits}))",
        f"transform(hits, s -> named_struct('value', s.m, 'kind', s.kind, 'pseudonym', {new}))",
    ]


def pseudonymise(docs: DataFrame, key: str, text: str = "text", rounds: int = ROUNDS, back: bool = False) -> DataFrame:
    """``docs`` with ``safe_text``, ``found`` (array of struct(value, kind, pseudonym), in text order) and ``n_replaced``.

    Numbers that look like a kind but fail its test have a null kind and stay as they are. Null
    texts stay null with nothing found; empty ones stay empty; texts, names and secrets of any length
    are read whole. Repeated rows are treated each by itself, and an empty table gives no rows. ``back=True`` undoes the numbers and
    dates of a text made with the same key. Columns called like the results give way to them.
    """
    if "'" in key or "\\" in key:
        raise ValueError("the key may hold neither quotes nor backslashes")
    rest = docs.drop("safe_text", "found", "n_replaced", "_hits")
    t = F.col(f"`{text}`")
    out = rest.withColumn("_hits", F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0)))
    for sql in _steps(key, rounds, back):
        out = out.withColumn("_hits", F.expr(sql.replace("transform(hits,", "transform(_hits,")))
    joined: Column = F.array_join(
        F.zip_with(F.split(t, PATTERN, -1), F.col("_hits.pseudonym"), lambda g, p: F.concat(g, F.coalesce(p, F.lit("")))), ""
    )
    n = F.size(F.filter("_hits", lambda h: h["kind"].isNotNull()))
    return (
        out.withColumn("safe_text", F.when(n > 0, joined).otherwise(t))
        .withColumn("n_replaced", F.when(t.isNull(), 0).otherwise(n))
        .withColumn("found", F.coalesce("_hits", F.expr("cast(array() as array<struct<value:string,kind:string,pseudonym:string>>)")))
        .drop("_hits")
    )
