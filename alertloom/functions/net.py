"""Address and service helpers as SQL expression text."""

from alertloom.functions.coerce import case, flag, quoted, text

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(\.{_OCTET}){{3}}$"

# Address blocks that are not globally reachable, as prefixes of a valid IPv4 text.
PRIVATE_IPV4 = (
    r"^(0\.|10\.|127\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.|192\.0\.2\."
    r"|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|24[0-9]\.|25[0-5]\.)"
)
PRIVATE_IPV6 = r"^(::1$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:)"


def is_private(address: str) -> str:
    return flag(
        f"({address} RLIKE {quoted(PRIVATE_IPV4)} AND {address} RLIKE {quoted(IPV4)} "
        f"AND {address} NOT IN ('192.0.0.9', '192.0.0.10')) "
        f"OR (lower({address}) RLIKE {quoted(PRIVATE_IPV6)} "
        f"AND lower({address}) RLIKE '^[0-9a-f:]+$')"
    )


def same_subnet_24(a: str, b: str) -> str:
    """First three of exactly four dot-separated parts are equal."""
    def dots(x: str) -> str:
        return f"length({text(x)}) - length(replace({text(x)}, '.', ''))"

    return flag(f"{dots(a)} = 3 AND {dots(b)} = 3 "
                f"AND substring_index({a}, '.', 3) = substring_index({b}, '.', 3)")


def service_name(port: str, service: str) -> str:
    """Service label from port and name; the first matching row of the table wins."""
    name = f"upper(trim({text(service)}))"
    return case(
        (f"{port} = 22 OR {name} = 'SSH'", "'SSH'"),
        (f"{port} = 3389 OR {name} = 'RDP'", "'RDP'"),
        (f"{port} IN (5985, 5986) OR {name} IN ('WINRM', 'WMI')", "'WINRM'"),
        (f"{port} = 161 OR {name} = 'SNMP'", "'SNMP'"),
        (f"{port} = 443", "'HTTPS'"),
        (f"{port} = 80 OR {name} IN ('HTTP', 'HTTPS')", "'HTTP'"),
        (f"{port} = 53 OR {name} = 'DNS'", "'DNS'"),
        (f"{port} = 25 OR {name} IN ('SMTP', 'SMTPS')", "'SMTP'"),
        otherwise=f"coalesce(nullif({name}, ''), 'NA')",
    )
