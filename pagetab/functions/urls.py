"""URL columns: normalise, admit, resolve, percent-decode.

Everything stays on the JVM. A URL is cut into its parts by one regular
expression pass that re-joins the groups with U+0001 (a character no accepted
URL holds) followed by one split, and ``let`` binds the parts so that they are
computed once per row however often the checks look at them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from pagetab.functions.reuse import reusable

# Query keys that may carry a secret.
SENSITIVE_KEYS = (
    "token",
    "access_token",
    "api_key",
    "apikey",
    "password",
    "secret",
    "authorization",
    "signature",
)
# Fixed value: longest URL accepted, in code points.
MAX_URL_CHARS = 4096

OUTSIDE_ORIGIN = "outside_origin"
INVALID_URL = "invalid_or_sensitive_url"

_CUT = "\x01"
_ABSOLUTE = r"(?s)\A(?i:(https?))://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
_AUTHORITY = r"\A(?:\[([^\[\]@]*)\]|([^:\[\]@]+))(?::([0-9]*))?\z"
_REFERENCE = r"(?s)\A(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
_SCHEME = r"\A([A-Za-z][A-Za-z0-9+.\-]*):"
_LABELS = r"\A(?:[^.]{1,63}\.)*[^.]{0,63}\z"
_HEX = "[0-9A-Fa-f]{1,4}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_V6_FULL = rf"\A(?:{_HEX}:){{7}}{_HEX}\z"
_V6_SHORT = rf"\A(?:{_HEX}(?::{_HEX})*)?::(?:{_HEX}(?::{_HEX})*)?\z"
_V6_TAIL = rf":{_OCTET}(?:\.{_OCTET}){{3}}\z"
_SECRET = "|".join(SENSITIVE_KEYS)
# URLs that are normal already but for a fragment: lower-case host without a
# port, a path, and an ASCII query without escapes and without a sensitive key.
_NORMAL = (
    r"\Ahttps?://(?:[a-z0-9_\-]{1,63}\.)*[a-z0-9_\-]{1,63}/[^\x00-\x1f\\?#]*+"
    rf"(?:\?(?!(?:[^#]*&)?(?i:{_SECRET})=)[ -~&&[^#%+\\]]++)?(?:#[^\x00-\x1f\\]*+)?\z"
)
# References without dot segments, parameters or anything to clean up, and bases they can simply be put behind.
_PLAIN_TAIL = r"(?:\?[^\x00-\x1f#]++)?(?:#[^\x00-\x1f]*+)?\z"
_ROOTED_REF = r"\A/(?![/.])(?:[^\x00-\x1f?#;/]|/(?!\.))*+" + _PLAIN_TAIL
_NEARBY_REF = r"\A(?![./?#;])(?:[^\x00-\x20?#;:/]|/(?![./]))(?:[^\x00-\x1f?#;:/]|/(?![./]))*+" + _PLAIN_TAIL
_BASE_ORIGIN = r"\Ahttps?://[^/?#]++(?=/)"
_BASE_FOLDER = r"\A(https?://[^/?#]++/(?:[^./?#;][^/?#;]*+/)*+)[^/?#]*+(?:[?#]|\z)"
_DOTTED = r"(?:\A|/)\.\.?(?:/|\z)"
_PATH_SAFE = r"A-Za-z0-9\-._~:/?@!$&'()*+,;=%"
_QUERY_SAFE = _PATH_SAFE.replace("'", "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it as often as ``body`` likes."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _with_groups(value: Column, pattern: str, count: int, body: Callable[..., Column]) -> Column:
    """Call ``body`` with the groups of a whole-string match.

    Without a match the second and later groups are null, which makes every
    result below null. The pattern runs once per row.
    """
    joined = F.regexp_replace(value, pattern, "".join(f"${i + 1}{_CUT}" for i in range(count)))
    return let(F.split(joined, _CUT), lambda parts: body(*[F.get(parts, F.lit(i)) for i in range(count)]))


def percent_decode(value: Column) -> Column:
    """Decode %XX once as UTF-8; ``+`` and broken escapes stay as they are."""
    plus_kept = F.replace(value, F.lit("+"), F.lit("%2B"))
    repaired = F.regexp_replace(plus_kept, "%(?![0-9A-Fa-f]{2})", "%25")
    return F.when(value.contains("%"), F.url_decode(repaired)).otherwise(value)


def has_sensitive_query(query: Column) -> Column:
    """True when a query string gives a non-empty value to a key that may carry a secret."""

    def leaks(pair: Column) -> Column:
        key = F.replace(F.substring_index(pair, "=", 1), F.lit("+"), F.lit(" "))
        # Upper case is full case folding once three letters are put right:
        # the Kelvin sign, capital sharp s, and dotless i (which folds to itself).
        folded = F.upper(F.translate(percent_decode(key), "\u212a\u1e9e\u0131", "k\u00df\x01"))
        return pair.rlike(r"(?s)\A[^=]*=.") & folded.isin(*(k.upper() for k in SENSITIVE_KEYS))

    return F.when(query.contains("="), F.exists(F.split(query, "&"), leaks)).otherwise(F.lit(False))


def _is_ipv6(text: Column) -> Column:
    address = F.regexp_replace(F.substring_index(text, "%", 1), _V6_TAIL, ":f:f")
    zone_ok = (F.instr(text, "%") == 0) | text.rlike(r"\A[^%]+%[^%]+\z")
    short = address.rlike(_V6_SHORT) & (F.regexp_count(address, F.lit(_HEX)) <= 7)
    return zone_ok & (address.rlike(_V6_FULL) | short)


def _ascii_host(host: Column) -> Column:
    """Lower-case ASCII form of a host name, null when it has none."""
    # java.net.IDN is the same 2003 standard as the reference behaviour; only
    # the rare non-ASCII host reaches it because CASE branches are lazy.
    puny = F.lower(F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), host, F.lit(1)))
    checked = let(puny, lambda p: F.when(~p.rlike(r"[/?#@:\[\]\\]"), p))
    return (
        F.when(~host.rlike(r"[^\x00-\x7f]"), F.when(host.rlike(_LABELS), F.lower(host)))
        .otherwise(checked)
    )


def _authority(scheme: Column, netloc: Column) -> Column:
    """host[:port] in normal form, null when the authority is not acceptable."""

    def build(bracketed: Column, plain: Column, port: Column) -> Column:
        literal_ok = _is_ipv6(bracketed) | bracketed.rlike(r"\Av[0-9A-Fa-f]+\..+\z")
        literal = F.when(literal_ok & bracketed.rlike(_LABELS), F.lower(bracketed))
        literal = F.when(bracketed.contains(":"), F.concat(F.lit("["), literal, F.lit("]"))).otherwise(literal)
        host = F.when(plain != "", _ascii_host(plain)).when(bracketed != "", literal)
        number = port.try_cast("bigint")
        default = F.when(scheme == "https", F.lit(443)).otherwise(F.lit(80))
        return (
            F.when(port == "", host)
            .when(number == default, host)
            .when(number <= 65535, F.concat(host, F.lit(":"), number.cast("string")))
        )

    return _with_groups(netloc, _AUTHORITY, 3, build)


@reusable
def normalize_url(value: Column) -> Column:
    """Normal form of an http(s) URL, or null when the URL must not be used.

    Null for: too long, control characters or backslashes, another scheme, no
    host, any userinfo, a bad port or host, or a sensitive query. Most URLs pass
    one pattern that tells they are normal already; the others are taken apart.
    """

    def build(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
        text = F.concat(
            F.lower(scheme),
            F.lit("://"),
            _authority(F.lower(scheme), netloc),
            F.when(path == "", F.lit("/")).otherwise(path),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query)),
        )
        return F.when(~has_sensitive_query(query), text)

    allowed = (F.length(value) <= MAX_URL_CHARS) & ~value.rlike(r"[\x00-\x1f\\]")
    usual = value.rlike(_NORMAL) & (F.length(value) <= MAX_URL_CHARS)
    return F.when(usual, F.substring_index(value, "#", 1)).otherwise(
        F.when(allowed, _with_groups(F.ltrim(value), _ABSOLUTE, 4, build))
    )


@reusable
def url_origin(normalized: Column) -> Column:
    """scheme://authority of a normalised URL."""
    found = F.regexp_extract(normalized, r"\Ahttps?://[^/?#]*", 0)
    return F.when(found != "", found)


def refusal(normalized: Column, allowed_origin: Column) -> Column:
    """Why a normalised URL (null: not usable) is outside an origin, or null when it is inside."""
    return (
        F.when(normalized.isNull() | (F.length(normalized) > MAX_URL_CHARS), F.lit(INVALID_URL))
        .when(~normalized.startswith(F.concat(allowed_origin, F.lit("/"))), F.lit(OUTSIDE_ORIGIN))
    )


@reusable
def admit(value: Column, allowed_origin: Column) -> Column:
    """struct(url, reason): a URL admitted to an exact origin, or why it is not."""

    def decide(url: Column) -> Column:
        reason = refusal(url, allowed_origin)
        return F.struct(F.when(reason.isNull(), url).alias("url"), reason.alias("reason"))

    return let(normalize_url(value), decide)


def _quoted(text: Column, safe: str) -> Column:
    runs = F.regexp_extract_all(text, F.lit(f"(?s)[{safe}]+|[^{safe}]+"), F.lit(0))
    coded = F.transform(
        runs,
        lambda run: F.when(run.rlike(f"[^{safe}]"), F.replace(F.url_encode(run), F.lit("+"), F.lit("%20"))).otherwise(run),
    )
    return F.when(text.rlike(f"[^{safe}]"), F.array_join(coded, "")).otherwise(text)


@reusable
def request_url(normalized: Column) -> Column:
    """The form in which a normalised URL is requested and recorded: unsafe characters as %XX."""

    def build(scheme: Column, netloc: Column, path: Column, query: Column) -> Column:
        return F.concat(
            scheme, F.lit("://"), netloc, _quoted(path, _PATH_SAFE),
            F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), _quoted(query, _QUERY_SAFE))),
        )

    unsafe = normalized.rlike(f"[^{_QUERY_SAFE}]")
    return F.when(unsafe, _with_groups(normalized, _ABSOLUTE, 4, build)).otherwise(normalized)


def _without_dots(path: Column) -> Column:
    """Apply ``.`` and ``..`` segments of a path."""

    def step(done: Column, segment: Column) -> Column:
        shorter = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return (
            F.when(segment == "..", shorter)
            .when(segment == ".", done)
            .otherwise(F.concat(done, F.array(segment)))
        )

    kept = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    ended = F.when(path.rlike(r"(?:\A|/)\.\.?\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.array_join(ended, "/")


def _without_empty_params(path: Column) -> Column:
    """Drop a lone ``;`` that ends the last segment."""
    return F.regexp_replace(path, r"(?s)\A((?:.*/)?[^;/]*);\z", "$1")


@reusable
def resolve_url(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` on a page at ``base``; fragments are dropped.

    References that name another scheme come back unchanged, as do references
    on a base that is not http(s); ``normalize_url`` then judges them.
    """

    def join(
        base_scheme: Column, netloc: Column, base_path: Column, base_query: Column,
        ref_netloc: Column, raw_path: Column, ref_query: Column,
    ) -> Column:
        scheme, ref_path = F.lower(base_scheme), _without_empty_params(raw_path)
        folder = F.regexp_extract(base_path, r"(?s)\A.*/", 0)
        folder = F.when(folder == "", F.lit("/")).otherwise(folder)
        params = F.regexp_extract(ref_path, r";[^/]*\z", 0)
        bare = F.substring(ref_path, F.lit(1), F.length(ref_path) - F.length(params))
        whole = (
            F.when(bare.startswith("/"), bare)
            .otherwise(F.regexp_replace(F.concat(folder, bare), "/{2,}", "/"))
        )
        flat = let(whole, lambda w: F.when(w.rlike(_DOTTED), _without_dots(w)).otherwise(w))
        rooted = let(flat, lambda f: F.when(f.startswith("/"), f).otherwise(F.concat(F.lit("/"), f)))
        path = F.when(ref_path == "", _without_empty_params(base_path)).otherwise(F.concat(rooted, params))
        query = F.when((ref_path == "") & (ref_query == ""), base_query).otherwise(ref_query)
        tail = F.when(query == "", F.lit("")).otherwise(F.concat(F.lit("?"), query))
        ref_tail = F.when(ref_query == "", F.lit("")).otherwise(F.concat(F.lit("?"), ref_query))
        return F.when(
            ref_netloc != "", F.concat(scheme, F.lit("://"), ref_netloc, ref_path, ref_tail)
        ).otherwise(F.concat(scheme, F.lit("://"), netloc, path, tail))

    def against(cleaned: Column) -> Column:
        scheme = F.lower(F.regexp_extract(cleaned, _SCHEME, 1))
        base_scheme = F.lower(F.regexp_extract(base, _SCHEME, 1))
        local = F.regexp_replace(cleaned, _SCHEME, "")
        joined = _with_groups(
            base, _ABSOLUTE, 4, lambda *b: _with_groups(local, _REFERENCE, 3, lambda *r: join(*b, *r))
        )
        return F.when(
            base_scheme.isin("http", "https") & ((scheme == "") | (scheme == base_scheme)), joined
        ).otherwise(href)

    general = let(F.regexp_replace(href, r"\A[\x00-\x20]+|[\t\r\n]", ""), against)
    origin, folder = F.regexp_extract(base, _BASE_ORIGIN, 0), F.regexp_extract(base, _BASE_FOLDER, 1)
    plain = F.substring_index(href, "#", 1)
    return (
        F.when(href.rlike(_ROOTED_REF) & (origin != ""), F.concat(origin, plain))
        .when(href.rlike(_NEARBY_REF) & (folder != ""), F.concat(folder, plain))
        .otherwise(general)
    )
