"""Limits of every crawl: defaults, validation, start-host rules."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column, DataFrame, functions as F

from pagetab.functions.reuse import reusable
from pagetab.functions.urls import let, normalize_url, url_origin

# Limits used when a policy does not state them.
DEFAULTS = {
    "max_pages": 20,
    "max_requests": 25,
    "max_candidates": 500,
    "max_body_bytes": 2_000_000,
    "max_text_chars": 5000,
    "delay": 0.5,
    "timeout": 10.0,
    "allow_loopback": False,
}

# Upper bounds of the whole-number limits (each is at least 1).
UPPER_BOUNDS = {
    "max_pages": 1000,
    "max_requests": 2000,
    "max_candidates": 10_000,
    "max_body_bytes": 10_000_000,
    "max_text_chars": 100_000,
}

# IPv4 networks that are not global, and the exceptions inside them.
NOT_GLOBAL_V4 = (
    "0.0.0.0/8",
    "10.0.0.0/8",
    "100.64.0.0/10",
    "127.0.0.0/8",
    "169.254.0.0/16",
    "172.16.0.0/12",
    "192.0.0.0/24",
    "192.0.2.0/24",
    "192.168.0.0/16",
    "198.18.0.0/15",
    "198.51.100.0/24",
    "203.0.113.0/24",
    "240.0.0.0/4",
)
GLOBAL_V4_EXCEPTIONS = ("192.0.0.9/32", "192.0.0.10/32")

# The same for IPv6.
NOT_GLOBAL_V6 = (
    "::/128",
    "::1/128",
    "::ffff:0:0/96",
    "64:ff9b:1::/48",
    "100::/64",
    "2001::/23",
    "2001:db8::/32",
    "2002::/16",
    "fc00::/7",
    "fe80::/10",
)
GLOBAL_V6_EXCEPTIONS = (
    "2001:1::1/128",
    "2001:1::2/128",
    "2001:3::/32",
    "2001:4:112::/48",
    "2001:20::/28",
    "2001:30::/28",
)

GLOBAL, LOOPBACK, NOT_GLOBAL = "global", "loopback", "not_global"


def with_defaults(policies: DataFrame) -> DataFrame:
    """Fill every missing limit, also where the whole column is missing."""
    types = {"delay": "double", "timeout": "double", "allow_loopback": "boolean"}

    def filled(name: str) -> Column:
        default = F.lit(DEFAULTS[name]).cast(types.get(name, "int"))
        return F.coalesce(F.col(name), default) if name in policies.columns else default

    return policies.withColumns({name: filled(name) for name in DEFAULTS})


def _in_networks(number: Column, networks: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for network in map(ipaddress.ip_network, networks):
        found = found | number.between(int(network.network_address), int(network.broadcast_address))
    return found


_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def _dotted_number(dotted: Column) -> Column:
    return F.aggregate(F.split(dotted, r"\."), F.lit(0).cast("bigint"), lambda n, part: n * 256 + part.cast("bigint"))


def _ipv4_class(plain: Column) -> Column:
    """Class of a dotted IPv4 literal, null for any other name; networks are number ranges."""

    def judge(n: Column) -> Column:
        private = _in_networks(n, NOT_GLOBAL_V4) & ~_in_networks(n, GLOBAL_V4_EXCEPTIONS)
        return (
            F.when(_in_networks(n, ("127.0.0.0/8",)), F.lit(LOOPBACK)).when(private, F.lit(NOT_GLOBAL)).otherwise(F.lit(GLOBAL))
        )

    return F.when(plain.rlike(rf"\A{_OCTET}(?:\.{_OCTET}){{3}}\z"), let(_dotted_number(plain), judge))


def _ipv6_digits(literal: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 literal, null for any other text.

    A zone after ``%`` says nothing about the address. A dotted end stands for two
    groups, ``::`` for as many groups of zeros as are missing, one at least.
    """
    group, zone = "[0-9a-f]{1,4}", r"\A([^%/]*)(?:%[^%/]+)?\z"
    bare = F.lower(F.regexp_extract(literal, zone, 1))
    tail = F.regexp_extract(bare, rf"(?<=:)({_OCTET}(?:\.{_OCTET}){{3}})\z", 1)

    def hexed(number: Column) -> Column:
        return F.concat_ws(":", F.lower(F.hex(F.floor(number / 65536).cast("bigint"))), F.lower(F.hex(number % 65536)))

    plain = F.when(tail == "", bare).otherwise(
        F.concat(F.left(bare, F.length(bare) - F.length(tail)), let(_dotted_number(tail), hexed)))

    def groups(text: Column) -> Column:
        return F.filter(F.split(text, ":"), lambda g: g != "")

    def filled(text: Column) -> Column:
        before, after = groups(F.substring_index(text, "::", 1)), groups(F.substring_index(text, "::", -1))
        missing = F.lit(8) - F.size(before) - F.size(after)
        short = F.when(missing >= 1, F.concat(before, F.array_repeat(F.lit("0"), missing), after))
        whole = text.rlike(rf"\A{group}(?::{group}){{7}}\z")
        cut = text.rlike(rf"\A(?:{group}(?::{group})*)?::(?:{group}(?::{group})*)?\z")
        return F.when(whole, groups(text)).when(cut, short)

    return F.array_join(F.transform(let(plain, filled), lambda g: F.lpad(g, 4, "0")), "")


def _ipv6_class(literal: Column) -> Column:
    """Class of an IPv6 literal, null for any other text; networks are ranges of digits, which order as the numbers do."""

    def within(digits: Column, networks: tuple[str, ...]) -> Column:
        found = F.lit(False)
        for network in map(ipaddress.ip_network, networks):
            found = found | digits.between(f"{int(network.network_address):032x}", f"{int(network.broadcast_address):032x}")
        return found

    def of_mapped(number: Column) -> Column:
        # what an IPv4 address stands for here is private or global; shared address space is not private
        private = _in_networks(number, tuple(n for n in NOT_GLOBAL_V4 if n != "100.64.0.0/10")) & ~_in_networks(number, GLOBAL_V4_EXCEPTIONS)
        return F.when(~private, F.lit(GLOBAL)).when(_in_networks(number, ("127.0.0.0/8",)), F.lit(LOOPBACK)).otherwise(F.lit(NOT_GLOBAL))

    def judge(digits: Column) -> Column:
        mapped = let(F.conv(F.substring(digits, 25, 8), 16, 10).cast("bigint"), of_mapped)
        return (
            F.when(within(digits, ("::ffff:0:0/96",)), mapped).when(within(digits, ("::1/128",)), F.lit(LOOPBACK))
            .when(within(digits, NOT_GLOBAL_V6) & ~within(digits, GLOBAL_V6_EXCEPTIONS), F.lit(NOT_GLOBAL))
            .when(digits.isNotNull(), F.lit(GLOBAL))
        )

    return let(_ipv6_digits(literal), judge)


@reusable
def host_class(normalized: Column) -> Column:
    """localhost, name, global, loopback or not_global for the host of a normalised URL."""
    literal = F.regexp_extract(normalized, r"\Ahttps?://\[([^\]]*)\]", 1)
    plain = F.regexp_extract(normalized, r"\Ahttps?://([^/?#:\[]*)", 1)
    named = let(plain, lambda p: F.when(p == "localhost", F.lit("localhost")).otherwise(_ipv4_class(p)))
    return F.coalesce(F.when(literal != "", _ipv6_class(literal)), named, F.lit("name"))


def validate(policies: DataFrame) -> DataFrame:
    """Normalise start_url and allowed_origin and add ``errors``, empty for a usable policy."""
    allowed = F.col("allowed_url")
    start = F.col("start")
    bare = (
        F.regexp_extract(allowed, r"\Ahttps?://[^/?#]*(.*)\z", 1).isin("/")
        & ~F.col("allowed_origin").rlike(r"#[\s\S]")
    )
    host = F.col("start_host")
    checks = [
        F.when(start.isNull(), F.lit("invalid_start_url")),
        F.when(allowed.isNull(), F.lit("invalid_allowed_origin")),
        F.when(allowed.isNotNull() & ~bare, F.lit("allow_origin_must_not_include_path_query_or_fragment")),
        F.when(url_origin("start") != url_origin("allowed_url"), F.lit("start_outside_allowed_origin")),
        *[
            F.when(~F.coalesce(F.col(name).between(1, upper), F.lit(False)), F.lit(f"invalid_{name}"))
            for name, upper in UPPER_BOUNDS.items()
        ],
        # NaN sorts above every number in Spark, so the range test also refuses it.
        F.when(~F.coalesce(F.col("delay").between(0, 60), F.lit(False)), F.lit("invalid_delay")),
        F.when(
            ~F.coalesce((F.col("timeout") > 0) & (F.col("timeout") <= 60), F.lit(False)), F.lit("invalid_timeout")
        ),
        F.when((host == "localhost") & ~F.col("allow_loopback"), F.lit("loopback_requires_explicit_flag")),
        F.when(
            (host == NOT_GLOBAL) | ((host == LOOPBACK) & ~F.col("allow_loopback")), F.lit("non_public_ip_literal")
        ),
    ]
    return (
        policies.withColumn("start", normalize_url("start_url"))
        .withColumn("allowed_url", normalize_url("allowed_origin"))
        .withColumn("start_host", host_class("start"))
        .withColumn("errors", F.array_compact(F.array(*checks)))
        .withColumn("start_url", F.coalesce(F.col("start"), F.col("start_url")))
        .withColumn("allowed_origin", F.coalesce(url_origin("allowed_url"), F.col("allowed_origin")))
        .drop("start", "allowed_url", "start_host")
    )


def usable(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") == 0).drop("errors")


def refused(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0)
