"""IP address arithmetic (F1-F3) as native Spark expressions.

IPv4 is strict dotted-quad: octets 0-255 without leading zeros, so
``256.1.1.1`` and ``01.2.3.4`` are invalid (value 0), as in Python >= 3.9.5.
IPv6 needs 128 bits, more than BIGINT or DECIMAL(38,0) hold: it is returned as
two unsigned 64-bit halves (DECIMAL(20,0)) plus a DOUBLE approximation.
An embedded IPv4 tail (``::ffff:1.2.3.4``) is accepted, and IPv4-mapped
addresses print with it, as Python's ``ipaddress`` does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4_PATTERN = rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$"
_HEXGROUP = r"^[0-9a-fA-F]{1,4}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``body(v)`` with ``v`` bound once to ``value`` (keeps the
    expression tree linear when a sub-expression is used several times)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def is_valid_ipv4(c) -> Column:
    return F.coalesce(_col(c).rlike(IPV4_PATTERN), F.lit(False))


def ipv4_to_int(c) -> Column:
    """Dotted quad -> BIGINT; invalid or NULL -> 0."""
    c = _col(c)
    parts = F.split(c, r"\.")
    value = None
    for i in range(4):
        octet = F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint")
        term = octet * F.lit(256 ** (3 - i))
        value = term if value is None else value + term
    return F.when(is_valid_ipv4(c), value).otherwise(F.lit(0).cast("bigint"))


def _ipv6_groups(c) -> Column:
    """Array of 8 hex groups for a syntactically valid IPv6 text, else NULL."""
    empty = F.array().cast("array<string>")

    def from_text(s: Column) -> Column:
        n_double = F.size(F.split(s, "::")) - 1
        left = F.split_part(s, F.lit("::"), F.lit(1))
        right = F.split_part(s, F.lit("::"), F.lit(2))
        left_groups = F.when(left == "", empty).otherwise(F.split(left, ":"))
        right_groups = F.when(right == "", empty).otherwise(F.split(right, ":"))

        def expand(lr: Column) -> Column:
            missing = F.lit(8) - F.size(lr["l"]) - F.size(lr["r"])
            compressed = F.concat(lr["l"], F.array_repeat(F.lit("0"), F.greatest(missing, F.lit(0))), lr["r"])
            return F.when(n_double == 0, F.split(s, ":")).when((n_double == 1) & (missing >= 1), compressed)

        groups = let(F.struct(left_groups.alias("l"), right_groups.alias("r")), expand)

        def check(g: Column) -> Column:
            ok = ((F.size(g) == 8) & F.forall(g, lambda x: x.rlike(_HEXGROUP))
                  & s.contains(":") & ~s.contains(":::"))
            return F.when(F.coalesce(ok, F.lit(False)), g)

        return let(groups, check)

    def v4_tail_to_hex(s: Column) -> Column:
        """``...:a.b.c.d`` -> ``...:hhhh:hhhh`` (embedded IPv4 in the last 32 bits)."""
        tail = F.regexp_extract(s, rf":({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})$", 1)
        o = F.split(tail, r"\.")
        def pair(i):
            return F.lower(F.hex(F.try_element_at(o, F.lit(i)).try_cast("int") * 256
                                 + F.try_element_at(o, F.lit(i + 1)).try_cast("int")))
        rebuilt = F.concat(F.substring(s, F.lit(1), F.length(s) - F.length(tail)), pair(1), F.lit(":"), pair(3))
        return F.when(tail != "", rebuilt).otherwise(s)

    stripped = F.regexp_replace(_col(c), "%.*$", "")                  # zone index dropped
    return let(let(stripped, v4_tail_to_hex), from_text)


def is_valid_ipv6(c) -> Column:
    return _ipv6_groups(c).isNotNull()


def ipv6_halves(c) -> Column:
    """STRUCT<hi DECIMAL(20,0), lo DECIMAL(20,0)> for IPv6 text, NULL otherwise."""
    dec = "decimal(20,0)"

    def halves(g: Column) -> Column:
        def half(offset: int) -> Column:
            acc = F.lit(0).cast(dec)
            for i in range(4):
                v = F.conv(F.element_at(g, offset + i + 1), 16, 10).cast(dec)
                acc = (acc * F.lit(65536).cast(dec) + v).cast(dec)
            return acc
        return F.when(g.isNotNull(), F.struct(half(0).alias("hi"), half(4).alias("lo")))

    return let(_ipv6_groups(c), halves)


def ip_to_int(c) -> Column:
    """IP text -> number (DOUBLE): IPv4 exact, IPv6 approximate, invalid -> 0."""
    c = _col(c)

    def v6(h: Column) -> Column:
        return F.when(h.isNotNull(), h["hi"].cast("double") * F.lit(float(2 ** 64)) + h["lo"].cast("double"))

    return (F.when(is_valid_ipv4(c), ipv4_to_int(c).cast("double"))
            .otherwise(F.coalesce(let(ipv6_halves(c), v6), F.lit(0.0))))


def canonical_ip(c) -> Column:
    """Canonical text of a valid address (IPv4 as is; IPv6 lower-case,
    no leading zeros, leftmost longest zero run compressed); NULL if invalid."""
    c = _col(c)

    def compress(short: Column) -> Column:
        out = short
        # leftmost longest run (>= 2 groups) of zero groups becomes "::"
        for run in range(2, 9):
            zeros = "0" + ":0" * (run - 1)
            hit = rf"(^|:){zeros}(:|$)"
            pat = rf"^((?:[0-9a-f]+:)*?){zeros}((?::[0-9a-f]+)*)$"
            replaced = F.regexp_replace(F.regexp_replace(short, pat, "$1|$2"), r":?\|:?", "::")
            out = F.when(short.rlike(hit), replaced).otherwise(out)
        return out

    def from_groups(g: Column) -> Column:
        short = F.array_join(F.transform(g, lambda x: F.lower(F.conv(x, 16, 16))), ":")
        num = lambda i: F.conv(F.element_at(g, i), 16, 10).cast("int")
        # IPv4-mapped addresses print their last 32 bits as a dotted quad
        mapped = F.forall(F.slice(g, 1, 5), lambda x: F.conv(x, 16, 10) == "0") & (num(6) == 65535)
        dotted = F.concat_ws(".", (num(7) / 256).cast("int").cast("string"), (num(7) % 256).cast("string"),
                             (num(8) / 256).cast("int").cast("string"), (num(8) % 256).cast("string"))
        return (F.when(g.isNull(), F.lit(None).cast("string"))
                .when(mapped, F.concat(F.lit("::ffff:"), dotted))
                .otherwise(let(short, compress)))

    zone = F.regexp_extract(c, "(%.*)$", 1)          # a zone index is kept, as written
    return F.when(is_valid_ipv4(c), c).otherwise(F.concat(let(_ipv6_groups(c), from_groups), zone))
