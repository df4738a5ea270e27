"""Scalar functions as column expressions: they stay in generated code and reach the scan."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Kinds of secrets and the patterns that show them. The patterns mean the same in Java, RE2 and Python.
SECRET_KINDS = {
    "assigned": r"(?i)(password|passwd|pwd|secret|token|api[_-]?key)[ ]*[=:][ ]*['\"]?[^ '\";]{4,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "github_token": r"gh[pousr]_[A-Za-z0-9]{20,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "url_login": r"://[^/ :@]+:[^/ :@]+@",
}
#: Replacements that keep the key or shape and hide the value.
MASKS = [
    (r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)[ ]*[=:][ ]*['\"])[^'\"\r\n]{4,}", "$1***"),
    (r"(?i)((?:password|passwd|pwd|secret|token|api[_-]?key)[ ]*[=:][ ]*)[^ '\";]{4,}", "$1***"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n \\:,.-]*?-----END [A-Z ]*PRIVATE KEY-----", "***"),
    (r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\r\n]*", "***"),
    (r"AKIA[0-9A-Z]{16}", "***"),
    (r"gh[pousr]_[A-Za-z0-9]{20,}", "***"),
    (r"(://[^/ :@]+:)[^/ :@]+@", "$1***@"),
]
#: Licence families by rank: 0 permissive, 1 weak copyleft, 2 custom, 3 strong copyleft.
LICENCE_RANKS = [(r"^(MIT|APACHE-2\.0|BSD-[23]-CLAUSE|ISC|ZLIB|UNLICENSE|0BSD)$", 0), (r"^(LGPL|MPL|EPL|CDDL|MS-RL)", 1), (r"^(AGPL|GPL|SSPL)", 3)]


def mask(text: Column) -> Column:
    """The text with secret values as ``***``."""
    for pattern, to in MASKS:
        text = F.regexp_replace(text, pattern, to)
    return text


def secret_kinds(text: Column) -> Column:
    """Names of the kinds of secrets in the text, in order."""
    return F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(k)) for k, p in SECRET_KINDS.items()]))


def secret_setting(key: Column, value: Column) -> Column:
    """none, low (a placeholder) or high for a setting whose key names a secret."""
    named = key.rlike(r"(?i)(password|pwd|secret|token|apikey|api_key|connectionstring)")
    holder = value.rlike(r"^(__.*__|#\{.*\}#?|\$\{.*\}|\{\{.*\}\}|<.*>|)$")
    return F.when(~named | value.isNull(), "none").when(holder, "low").otherwise("high")


def url_host(url: Column) -> Column:
    """Lower-case host of a URL without login and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def url_port(url: Column) -> Column:
    """The port, or that of http and https, or null."""
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?[^/:?#]+:([0-9]+)", 1)
    return F.when(port != "", port.cast("int")).when(url_scheme(url) == "https", 443).when(url_scheme(url) == "http", 80)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)


def is_ip(host: Column) -> Column:
    return host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")


def private_ip(host: Column) -> Column:
    """Private, loopback and link-local addresses."""
    return host.rlike(r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)")


def host_kind(host: Column) -> Column:
    """internal, external or external-ip."""
    known = host.rlike(r"\.(com|net|org|io|edu|gov|info|biz|dev|app|cloud|[a-z]{2})$")
    inner = ~host.contains(".") | host.rlike(r"\.(local|internal|lan|corp|intranet|test)$") | host.rlike(r"(^|[.-])(dev|test|uat|staging|qa)([.-]|$)")
    return F.when(is_ip(host), F.when(private_ip(host), "internal").otherwise("external-ip")).when(inner | ~known, "internal").otherwise("external")


def connection(text: Column) -> Column:
    """A connection string as a map of trimmed, lower-cased keys."""
    pairs = F.filter(F.split(text, ";"), lambda x: x.contains("="))
    one = lambda x: F.struct(F.lower(F.trim(F.substring_index(x, "=", 1))).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v"))
    return F.map_from_entries(F.transform(pairs, one))


def connection_engine(text: Column) -> Column:
    """The database engine that a connection string is for."""
    low = F.lower(text)
    return F.when(low.rlike(r"(^|;)[ ]*(initial catalog|server|trusted_connection|integrated security)[ ]*=") & ~low.rlike(r"port[ ]*=[ ]*5432"), "SQL Server").when(low.rlike(r"(^|;)[ ]*host[ ]*=|port[ ]*=[ ]*5432"), "PostgreSQL").when(low.contains("service_name"), "Oracle").when(low.rlike(r"\.(db|sqlite|mdb)"), "file").otherwise("unknown")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")


def identifier_words(name: Column) -> Column:
    """Lower-case words of an identifier in camel case, snake case or with digits."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[^a-z0-9]+"), lambda x: x != "")


def stem(word: Column) -> Column:
    """The word without the first of ing, ed, es, e, s that leaves three letters (a final ss stays)."""
    out = word
    for end in reversed(["ing", "ed", "es", "e", "s"]):
        fits = word.endswith(end) & (F.length(word) >= len(end) + 3)
        if end == "s":
            fits = fits & ~word.endswith("ss")
        out = F.when(fits, F.substring(word, F.lit(1), F.length(word) - len(end))).otherwise(out)
    return out


def version(text: Column) -> Column:
    """Up to four numbers of a version, comparable as an array; what is not a number counts as 0."""
    parts = F.slice(F.split(F.regexp_replace(text, r"[-+].*$", ""), r"\."), 1, 4)
    return F.transform(parts, lambda x: F.when(x.rlike(r"^[0-9]{1,9}$"), x.cast("int")).otherwise(0))


def spdx_rank(expression: Column) -> Column:
    """The best alternative of an SPDX expression, each as bad as its worst part."""
    one = lambda x: _first(F.upper(F.trim(x)), LICENCE_RANKS, 2)
    bare = F.regexp_replace(expression, r"[()]", "")
    return F.array_min(F.transform(F.split(bare, "(?i) OR "), lambda a: F.array_max(F.transform(F.split(a, "(?i) AND "), one))))


def _first(value: Column, cases: list, other) -> Column:
    out = F.lit(other)
    for pattern, result in reversed(cases):
        out = F.when(value.rlike(pattern), result).otherwise(out)
    return out


def framework_class(tfm: Column) -> Column:
    """legacy, standard, modern or other for a target framework moniker."""
    low = F.lower(tfm)
    return F.when(low.rlike(r"^net(standard)"), "standard").when(low.rlike(r"^netcoreapp|^net([5-9]|[1-9][0-9])\.[0-9]"), "modern").when(low.rlike(r"^(net[1-4][0-9]{0,2}|v[1-4](\.[0-9])*)$"), "legacy").otherwise("other")


def support_status(ends: Column, on: Column) -> Column:
    return F.when(ends.isNull(), "unknown").when(ends < on, "out-of-support").when(ends < F.add_months(on, 12), "ending-soon").otherwise("supported")


def risk(impact: Column, likelihood: Column) -> Column:
    """Risk of an impact and a likelihood, each low, medium or high."""
    rank = lambda c: F.when(c == "high", 3).when(c == "medium", 2).when(c == "low", 1)
    product = rank(impact) * rank(likelihood)
    return F.when(product >= 6, "high").when(product >= 3, "medium").otherwise("low")


def first_sentence(text: Column, most: int = 110) -> Column:
    return F.substring(F.regexp_extract(F.regexp_replace(text, r"[ \t\r\n]+", " "), r"^(.*?[.!?])( |$)", 1), 1, most)


def squash(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def html_plain(text: Column) -> Column:
    """Text of markup: tags to blanks, blanks squeezed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def timespan(text: Column) -> Column:
    """[d.]hh:mm:ss in words."""
    at = lambda k: F.coalesce(F.regexp_extract(text, r"^(?:([0-9]+)\.)?([0-9]{1,2}):([0-9]{2}):([0-9]{2})", k).try_cast("int"), F.lit(0))
    parts = F.array_compact(F.array(*[F.when(at(k) > 0, F.concat_ws(" ", at(k).cast("string"), F.lit(u))) for k, u in ((1, "d"), (2, "h"), (3, "min"), (4, "s"))]))
    return F.when(~text.rlike(r"^([0-9]+\.)?[0-9]{1,2}:[0-9]{2}:[0-9]{2}"), text).otherwise(F.concat_ws(" ", parts))


def cron_text(text: Column) -> Column:
    p = F.split(text, " +")
    g = lambda k: F.get(p, F.lit(k))
    clock = F.concat(F.lpad(g(1), 2, "0"), F.lit(":"), F.lpad(g(0), 2, "0"))
    star = lambda *ks: [g(k) == "*" for k in ks]
    every = lambda *c: c[0] if len(c) == 1 else c[0] & every(*c[1:])
    minutes = F.regexp_extract(g(0), r"^\*/([0-9]+)$", 1)
    return F.when(F.size(p) != 5, text).when((minutes != "") & every(*star(1, 2, 3, 4)), F.concat(F.lit("every "), minutes, F.lit(" minutes"))).when(every(*star(0, 1, 2, 3, 4)), "every minute").when(every(*star(1, 2, 3, 4)), F.concat(F.lit("hourly at minute "), g(0))).when(every(*star(2, 3, 4)), F.concat(F.lit("daily at "), clock)).when(every(*star(2, 3)), F.concat(F.lit("weekly on day "), g(4), F.lit(" at "), clock)).when(every(*star(3, 4)), F.concat(F.lit("monthly on day "), g(2), F.lit(" at "), clock)).otherwise(text)


def env_of(file: Column) -> Column:
    """The environment in a settings file's name."""
    return F.lower(F.regexp_extract(file, r"(?i)(?:appsettings|web|app)\.([A-Za-z0-9_-]+)\.(?:json|config)$", 1))


def half_up(x: Column) -> Column:
    """Up to the next half."""
    return F.ceil(x * 2 - 1e-9) / 2


def curve(w: Column, anchors: list[tuple[float, float]]) -> Column:
    """Piecewise-linear through (w, value) anchors, flat outside, to the nearest half (ties to even)."""
    out = F.lit(float(anchors[-1][1]))
    for (a, x), (b, y) in reversed(list(zip(anchors, anchors[1:], strict=False))):
        out = F.when(w <= b, x + (w - a) * ((y - x) / (b - a))).otherwise(out)
    out = F.when(w <= anchors[0][0], float(anchors[0][1])).otherwise(out)
    return F.bround(out * 2) / 2


def triangular_inverse(u: Column, low: Column, high: Column, mode: Column) -> Column:
    cut = (mode - low) / (high - low)
    return F.when(high <= low, low).when(u < cut, low + F.sqrt(u * (high - low) * (mode - low))).otherwise(high - F.sqrt((1 - u) * (high - low) * (high - mode)))


def triangular_moments(low: Column, high: Column, mode: Column) -> tuple[Column, Column]:
    """(mean, standard deviation)."""
    square = low * low + high * high + mode * mode - low * high - low * mode - high * mode
    return (low + high + mode) / 3, F.sqrt(F.greatest(square, F.lit(0.0)) / 18)


def band(x: Column, limits: list[tuple[float, str]], other: str) -> Column:
    """The first band whose upper limit is not below x."""
    out = F.lit(other)
    for limit, name in reversed(limits):
        out = F.when(x <= limit, name).otherwise(out)
    return out


def rank_of(value: Column, order: list[str], unknown: int = 9) -> Column:
    out = F.lit(unknown)
    for k, name in reversed(list(enumerate(order))):
        out = F.when(value == name, k).otherwise(out)
    return out


def route_segments(route: Column) -> Column:
    """Lower-case segments of a route, parameters as ``*``."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(route), r"[?#].*$", ""), r"^/+|/+$", "")
    return F.transform(F.split(bare, "/+"), lambda s: F.when(s.rlike(r"^(\{.*\}|:.*|<.*>|\*)$"), "*").otherwise(s))


def package_group(status: Column) -> Column:
    low = F.lower(status)
    return F.when(low.rlike("vulnerab"), "security").when(low.rlike("deprecat|unlisted"), "replace").when(low.rlike("incompatib|legacy"), "port").when(low.rlike("update|outdated"), "update").otherwise("keep")


def config_decision(key: Column, value: Column) -> Column:
    """What becomes of a setting: secret values are replaced by references, addresses and paths by variables."""
    return F.when(secret_setting(key, value) == "high", "secret").when(value.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), "address").when(value.rlike(r"^([A-Za-z]:\\|\\\\|/[a-z])"), "path").when(F.lower(value).isin("true", "false") | value.rlike(r"^-?[0-9.]+$"), "keep").otherwise("review")
