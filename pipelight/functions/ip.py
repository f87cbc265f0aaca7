"""IP functions.  IPv4 is arithmetic on columns; IPv6 syntax is a regular expression built by rule."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
V4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"
_H = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or a gap (::) with k groups before and up to 7 - k after it.
V6 = "^(" + "|".join([f"({_H}:){{7}}{_H}", *(f"{':'.join([_H] * k)}::({_H}(:{_H}){{0,{6 - k}}})?" for k in range(7)), f"({_H}:){{7}}:"]) + ")$"


def is_v4(x: Column) -> Column:
    return x.rlike(V4)


def is_v6(x: Column) -> Column:
    return x.rlike(V6)


def to_int(x: Column) -> Column:
    part = F.split(F.when(is_v4(x), x), r"\.")
    return sum((part[i].cast("bigint") * 256 ** (3 - i) for i in range(4)), F.lit(0).cast("bigint"))


def from_int(n: Column) -> Column:
    n = n.cast("bigint")
    return F.when((n >= 0) & (n < 2**32), F.concat_ws(".", *(F.shiftright(n, 8 * (3 - i)).bitwiseAND(255).cast("string") for i in range(4))))


def _mask(bits: Column) -> Column:
    return (F.lit(2**32) - F.pow(F.lit(2.0), 32 - bits.cast("int")).cast("bigint")).cast("bigint")


def _mask_of(text: Column) -> Column:
    """A mask from prefix bits ("24", "/24", "10.0.0.0/24") or dotted form."""
    bits = F.regexp_extract(text.cast("string"), r"(?:^|/)([0-9]{1,2})$", 1)
    return F.when(bits != "", _mask(F.when(bits != "", bits).try_cast("int"))).otherwise(to_int(text.cast("string")))


def _within(x: Column, network: str, bits: int) -> Column:
    size = 2 ** (32 - bits)
    base = int(ipaddress.IPv4Address(network))
    return F.coalesce(to_int(x).between(base, base + size - 1), F.lit(False))


def private(x):
    return _within(x, "10.0.0.0", 8) | _within(x, "172.16.0.0", 12) | _within(x, "192.168.0.0", 16) | (is_v6(x) & F.lower(x).rlike("^f[cd]"))


def loopback(x):
    return _within(x, "127.0.0.0", 8) | (x == "::1") | (is_v6(x) & x.rlike("^(0{1,4}:){7}0{0,3}1$"))


def multicast(x):
    return _within(x, "224.0.0.0", 4) | (is_v6(x) & F.lower(x).rlike("^ff"))


def link_local(x):
    return _within(x, "169.254.0.0", 16) | (is_v6(x) & F.lower(x).rlike("^fe[89ab]"))


def _cidr6(x: Column, net: Column) -> Column:
    @F.pandas_udf("boolean")
    def run(addresses: pd.Series, networks: pd.Series) -> pd.Series:
        def one(a, n):
            try:
                return ipaddress.ip_address(a) in ipaddress.ip_network(n, strict=False)
            except (ValueError, TypeError):
                return None

        return pd.Series([one(a, n) for a, n in zip(addresses, networks, strict=True)], dtype=object)

    return run(x, net)


def cidr(x, net):
    """Whether address x lies in net; only a network written with colons needs Python."""
    from .scalar import Literal, col

    x, column = col(x), col(net)
    if isinstance(net, Literal) and ":" in str(net.value):
        return _cidr6(x, column)
    mask = _mask_of(column)
    return to_int(x).bitwiseAND(mask) == to_int(F.split(column, "/")[0]).bitwiseAND(mask)


FUNCTIONS = {
    "isValidIP": lambda x: is_v4(x) | is_v6(x), "isValidIPv4": is_v4, "isValidIPv6": is_v6, "isPrivateIP": private,
    "isPublicIP": lambda x: (is_v4(x) | is_v6(x)) & ~private(x) & ~loopback(x) & ~multicast(x) & ~link_local(x), "isLoopbackIP": loopback, "isMulticastIP": multicast,
    "cidr": cidr, "cidrContains": lambda net, x: cidr(x, net), "ipToInt": to_int, "intToIP": from_int,
    "ipNetwork": lambda x, m: from_int(to_int(x).bitwiseAND(_mask_of(m))), "ipBroadcast": lambda x, m: from_int(to_int(x).bitwiseOR(F.lit(2**32 - 1).bitwiseAND(F.bitwise_not(_mask_of(m))))),
    "ipNetmask": lambda x: from_int(_mask_of(x)), "ipRange": lambda x, a, b: to_int(x).between(to_int(a), to_int(b)),
}
RAW = frozenset(["cidr", "cidrcontains"])
