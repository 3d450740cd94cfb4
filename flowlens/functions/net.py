"""Column functions over packets: flow keys, networks, DNS names, HTTP requests, TLS fingerprints."""

from __future__ import annotations

import ipaddress
import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens import config


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests, F.lit(False))


def has_bits(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) != 0


def flow_ends(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column) -> tuple[Column, Column]:
    """Both ends (ip, port) of a flow, the smaller first; addresses compare as text."""
    a, b = F.struct(src_ip.alias("ip"), src_port.alias("port")), F.struct(dst_ip.alias("ip"), dst_port.alias("port"))
    return F.least(a, b), F.greatest(a, b)


def flow_id(src_ip: Column, src_port: Column, dst_ip: Column, dst_port: Column, protocol: Column) -> Column:
    a, b = flow_ends(src_ip, src_port, dst_ip, dst_port)
    return F.format_string("%d:%s:%d<->%s:%d", protocol, a["ip"], a["port"], b["ip"], b["port"])


def ipv4_number(ip: Column) -> Column:
    """IPv4 text as a number; null for anything else."""
    value = F.aggregate(F.split(ip, r"\."), F.lit(0).cast("long"), lambda x, part: x * 256 + part.cast("long"))
    return F.when(ip.rlike(r"^((25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(\.(?!$)|$)){4}$"), value)


def is_internal(ip: Column, networks: list[str]) -> Column:
    """Whether an IPv4 address is in one of the networks; other text is not. Networks that can't be read are passed over."""
    tests = []
    for text in networks:
        try:
            net = ipaddress.ip_network(text, strict=False)
        except ValueError:
            continue
        if net.version == 4:
            tests.append(ipv4_number(ip).bitwiseAND(F.lit(int(net.netmask))) == int(net.network_address))
    if not tests:
        return is_internal(ip, config.DEFAULTS["lateral"]["internal_subnets"])
    return F.coalesce(any_of(tests), F.lit(False))


def is_noise(qname: Column) -> Column:
    """Names of directory services and telemetry."""
    words = lambda names: "|".join(map(re.escape, names))
    whole = words(s.lstrip(".") for s in config.NOISE_SUFFIXES)
    return F.lower(qname).rlike(rf"^(?:{words(config.NOISE_PREFIXES)})|{words(config.NOISE_PARTS)}|(?:{words(config.NOISE_SUFFIXES)})\z|^(?:{whole})\z")


def split_domain(qname: Column) -> tuple[Column, Column]:
    """All labels but the last two, and those; of up to two labels the first one, and the name as it is."""
    labels = F.split(F.trim(qname, F.lit(".")), r"\.")
    n = F.size(labels)
    sub = F.when(n <= 2, labels[0]).otherwise(F.array_join(F.slice(labels, 1, F.greatest(n - 2, F.lit(1))), "."))
    return sub, F.when(n <= 2, qname).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def _letters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_shares(text: Column) -> Column:
    """Share of each character, as a map, rounded to 4 places."""
    chars = _letters(text)
    share = lambda c: F.round(F.size(F.filter(chars, lambda x: x == c)) / F.size(chars), 4)
    return F.map_from_entries(F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.struct(c.alias("key"), share(c).alias("value"))))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters in bits, rounded to 4 places."""
    chars = _letters(text)
    share = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars))
    return F.round(F.aggregate(share, F.lit(0.0), lambda sum_, p: sum_ - p * F.log2(p)), 4)


def consonant_run(text: Column) -> Column:
    """Length of the longest run of letters other than vowels."""
    runs = F.regexp_extract_all(text, F.lit(r"((?:(?![aeiouAEIOU])\p{L})+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def flag_names(flags: Column) -> Column:
    named = [F.when(has_bits(flags, bit), F.lit(name)) for bit, name in config.FLAG_NAMES]
    return F.filter(F.array(*named), lambda x: x.isNotNull())


def flag_anomaly(flags: Column) -> Column:
    """The first kind of anomaly that TCP flags show, or null."""
    return (
        F.when(flags == 0, "NULL scan")
        .when(flags.bitwiseAND(F.lit(0x29)) == 0x29, "XMAS scan")
        .when(has_bits(flags, 0x01) & ~has_bits(flags, 0x10), "FIN scan")
        .when(has_bits(flags, 0x02) & has_bits(flags, 0x01), "SYN-FIN")
    )


def ja3_text(tls: Column) -> Column:
    dashed = [F.array_join(F.transform(tls[f], lambda x: x.cast("string")), "-") for f in ("ciphers", "extensions", "supported_groups", "ec_point_formats")]
    return F.concat_ws(",", tls["version"].cast("string"), *dashed)


def ja4(tls: Column) -> Column:
    """Version, server name and counts, and the first 12 digits of the MD5 of sorted ciphers and of sorted extensions."""
    hexed = lambda f: F.array_join(F.transform(F.array_sort(tls[f]), lambda x: F.lpad(F.lower(F.hex(x)), 4, "0")), ",")
    count = lambda f: F.lpad(F.least(F.size(tls[f]), F.lit(99)).cast("string"), 2, "0")
    version = F.when(tls["version"] == 0x0304, "13").otherwise("12")
    named = F.when(F.coalesce(tls["sni"], F.lit("")) != "", "d").otherwise("i")
    short = lambda f: F.substring(F.md5(hexed(f).cast("binary")), 1, 12)
    return F.concat(F.lit("t"), version, named, count("ciphers"), count("extensions"), F.lit("00_"), short("ciphers"), F.lit("_"), short("extensions"))


def ascii_text(payload: Column) -> Column:
    """Bytes as text without those that aren't ASCII."""
    return F.regexp_replace(F.decode(payload, "ISO-8859-1"), r"[^\x00-\x7F]", "")


def http_request(text: Column) -> tuple[Column, Column, Column]:
    """Method (null: no request), URI and user agent (null: none)."""
    lines = F.split(text, "\r\n")
    parts = F.split(F.trim(lines[0], F.lit(" \t\n\r\x0b\x0c")), " ")
    method = F.upper(parts[0])
    method = F.when((F.size(parts) >= 2) & method.isin(config.HTTP_METHODS), method)
    agents = F.filter(F.slice(lines, 2, 1 << 20), lambda x: F.lower(x).startswith("user-agent:"))
    agent = F.trim(F.regexp_replace(F.get(agents, F.lit(0)), "^[^:]*:", ""), F.lit(" \t\n\r\x0b\x0c"))
    return method, F.get(parts, F.lit(1)), agent


def first_of(tests: list[tuple[Column, str]]) -> Column:
    """Name of the first test that holds, or null."""
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in tests))
