"""Network membership of IPv4 and IPv6 addresses."""

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

from loghelm.functions.text import quoted

IPV4_TEXT = r"^\d{1,3}(\.\d{1,3}){3}$"
IPV6_TEXT = r"^(?=[^:]*:)[0-9a-f:]+(\d{1,3}(\.\d{1,3}){3})?$"


def _ipv6_digits(address: str) -> str:
    """SQL: the 32 hexadecimal digits of an IPv6 address in any spelling; NULL for other text.

    Brackets and a zone are left out, a dotted tail becomes two groups, and what stands for
    ``::`` is filled with zeros. Lambda arguments name the steps.
    """
    part = "CAST(regexp_extract(a, '(\\\\d+)\\\\.(\\\\d+)\\\\.(\\\\d+)\\\\.(\\\\d+)$', {}) AS INT)"
    tail = "format_string('%02x%02x:%02x%02x', " + ", ".join(part.format(i) for i in (1, 2, 3, 4)) + ")"
    steps = [
        f"CASE WHEN rlike(a, {quoted(IPV6_TEXT)}) THEN a END",
        f"CASE WHEN contains(a, '.') THEN concat(substring_index(a, ':', length(a) - length(replace(a, ':', ''))), ':', {tail}) ELSE a END",
        "CASE WHEN contains(a, '::') THEN concat(substring_index(a, '::', 1), "
        "repeat(':0', 8 - size(filter(split(a, ':'), x -> x <> ''))), ':', substring_index(a, '::', -1)) ELSE a END",
        "filter(split(a, ':'), x -> x <> '')",
        "CASE WHEN size(a) = 8 THEN array_join(transform(a, x -> lpad(x, 4, '0')), '') END",
    ]
    value = f"lower(regexp_replace({address}, '[\\\\[\\\\]]|%.*$', ''))"
    for step in steps:
        value = f"element_at(transform(array({value}), a -> {step}), 1)"
    return value


def network_sql(address: str, cidr: str) -> str:
    """SQL: membership of the column in a network; NULL for text of the other version or none."""
    network = ipaddress.ip_network(cidr, strict=False)
    if network.version == 6:
        whole, rest = divmod(network.prefixlen, 4)
        start = f"{int(network.network_address):032x}"
        test = f"startswith(a, {quoted(start[:whole])})"
        if rest:
            bits = int(start[whole], 16) >> (4 - rest)
            test += f" AND shiftright(CAST(conv(substring(a, {whole + 1}, 1), 16, 10) AS INT), {4 - rest}) = {bits}"
        return f"element_at(transform(array({_ipv6_digits(address)}), a -> {test}), 1)"
    number = " + ".join(
        f"CAST(split_part({address}, '.', {i}) AS BIGINT) * {256 ** (4 - i)}L" for i in (1, 2, 3, 4)
    )
    first, last = int(network.network_address), int(network.broadcast_address)
    is_ipv4 = f"rlike({address}, {quoted(IPV4_TEXT)})"
    return f"(CASE WHEN {is_ipv4} THEN {number} END BETWEEN {first}L AND {last}L)"


def in_network(address: str, cidr: str) -> Column:
    return F.expr(network_sql(address, cidr))
