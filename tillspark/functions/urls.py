"""Endpoint address policy as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tillspark.functions.once import settle
from tillspark.functions.text import trim_blank

# Instance metadata services and names served without encryption.
METADATA_HOSTS = ("169.254.169.254", "169.254.170.2", "100.100.100.200",
                  "metadata.google.internal")
LOCAL_NAMES = ("localhost", "host.containers.internal")
LOCAL_SUFFIXES = r"\.(local|lan)$"

# IPv4 networks as (first address, prefix length).
LINK_LOCAL = (("169.254.0.0", 16),)
MULTICAST = (("224.0.0.0", 4),)
UNSPECIFIED = (("0.0.0.0", 32),)
RESERVED = (("240.0.0.0", 4),)
PRIVATE = (
    ("0.0.0.0", 8), ("10.0.0.0", 8), ("127.0.0.0", 8), ("169.254.0.0", 16),
    ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16),
    ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("240.0.0.0", 4),
)
PRIVATE_EXCEPT = (("192.0.0.9", 32), ("192.0.0.10", 32))

_SPLIT = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def clean_url(url: Column) -> Column:
    return F.rtrim(trim_blank(url), F.lit("/"))


def _part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, _SPLIT, group)


def _ipv4_number(host: Column) -> Column:
    """Dotted quad as a long, null for anything else."""
    octets = F.split(host, r"\.")
    number = F.lit(0).cast("long")
    for index in range(4):
        number = number * 256 + F.try_element_at(octets, F.lit(index + 1)).try_cast("long")
    return F.when(host.rlike("^" + r"\.".join([_OCTET] * 4) + "$"), number)


def _in_networks(number: Column, networks) -> Column:
    found = F.lit(False)
    for address, prefix in networks:
        first = 0
        for octet in address.split("."):
            first = first * 256 + int(octet)
        last = first + 2 ** (32 - prefix) - 1
        found = found | number.between(first, last)
    return F.coalesce(found, F.lit(False))


def _ipv6_first(host: Column) -> Column:
    """First 16 bits of an IPv6 literal, null for other hosts."""
    head = F.split_part(host, F.lit(":"), F.lit(1))
    return F.when(host.contains(":"), F.conv(F.when(head == "", "0").otherwise(head), 16, 10)
                  .cast("long"))


def audit_endpoints(df: DataFrame) -> DataFrame:
    """Cleans column ``url`` and adds the first rule it breaks as ``violation``.

    The violation is null when the address is allowed or empty. Each part is computed once;
    written as one expression the rules would not fit into a compiled method.
    """
    cleaned = df.withColumn("url", clean_url(F.col("url")))
    url = F.col("url")
    parts = settle(cleaned, _scheme=F.lower(_part(url, 1)), _authority=_part(url, 2),
                   _rest=F.concat(_part(url, 4), _part(url, 5)))
    authority = F.col("_authority")
    split = settle(parts, _user=F.regexp_extract(authority, r"^(.*)@", 1),
                   _host_port=F.regexp_replace(authority, r"^.*@", ""))
    host_port = F.col("_host_port")
    hosts = settle(split, _host=F.lower(
        F.when(host_port.startswith("["), F.regexp_extract(host_port, r"^\[([^\]]*)\]", 1))
        .otherwise(F.split_part(host_port, F.lit(":"), F.lit(1)))))
    host = F.col("_host")
    numbers = settle(hosts, _v4=_ipv4_number(host), _v6=_ipv6_first(host))
    v4, v6, scheme = F.col("_v4"), F.col("_v6"), F.col("_scheme")

    malformed = (~F.coalesce(scheme.isin("http", "https"), F.lit(False)) | (host == "")
                 | F.col("_user").rlike("[^:]") | (F.col("_rest") != ""))
    v6_special = (v6.between(0xFE80, 0xFEBF) | (v6 >= 0xFF00) | (v6 < 0x2000)
                  | v6.between(0x4000, 0xFBFF) | v6.between(0xFE00, 0xFE7F))
    special = (_in_networks(v4, LINK_LOCAL + MULTICAST + UNSPECIFIED + RESERVED)
               | F.coalesce(v6_special, F.lit(False)))
    local_name = host.isin(*LOCAL_NAMES) | host.rlike(LOCAL_SUFFIXES)
    private = ((_in_networks(v4, PRIVATE) & ~_in_networks(v4, PRIVATE_EXCEPT))
               | F.coalesce(v6.between(0xFC00, 0xFDFF) | host.startswith("2001:db8:"),
                            F.lit(False)))
    violation = (
        F.when(F.coalesce(url, F.lit("")) == "", F.lit(None).cast("string"))
        .when(malformed, "not_plain_http_url")
        .when(host.isin(*METADATA_HOSTS), "metadata_service")
        .when(special, "reserved_address")
        .when((scheme == "http") & ~(local_name | private), "public_cleartext"))
    return numbers.withColumn("violation", violation).select(*df.columns, "violation")
