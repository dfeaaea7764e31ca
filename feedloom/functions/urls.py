"""URL column functions, built on the generic URI split of RFC 3986, appendix B."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Address patterns that mark a URL as something other than an article.
AUTH_HOST_PREFIXES = ("accounts.", "account.", "auth.", "login.", "signin.", "sso.")
AUTH_PATHS = (
    "/login", "/signin", "/sign-in", "/signup", "/sign-up",
    "/register", "/auth", "/oauth", "/sso",
    "/password", "/forgot-password", "/reset-password",
    "/logout", "/signout", "/sign-out",
    "/subscribe", "/subscription", "/checkout", "/payment",
    "/unsubscribe", "/preferences/notifications",
)
AUTH_QUERY_KEYS = ("post_login_redirect", "redirect_uri", "return_to", "login_challenge")
AGGREGATOR_HOST = "news.google.com"
FEED_HOST_PREFIXES = ("feeds.", "feed.", "rss.", "xml.")
FEED_CDN_HOSTS = ("feeds.feedburner.com", "feedburner.com", "feedproxy.google.com")

_URI = r"^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?"


def _part(u: Column, group: int) -> Column:
    return F.regexp_extract(u, _URI, group)


def scheme(u: Column) -> Column:
    return F.lower(_part(u, 1))


def authority(u: Column) -> Column:
    return _part(u, 2)


def host(u: Column) -> Column:
    """Lower-cased host without user info and port; empty when there is none."""
    return F.lower(F.regexp_replace(authority(u), r"^.*@|:\d*$", ""))


def path(u: Column) -> Column:
    return _part(u, 3)


def query(u: Column) -> Column:
    return _part(u, 4)


def strip_www(h: Column) -> Column:
    return F.regexp_replace(h, r"^www\.", "")


def _alternation(words) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def is_non_article_url(u: Column) -> Column:
    """FLT-01: sign-in, account, checkout and redirect addresses."""
    by_host = host(u).rlike(f"^(?:{_alternation(AUTH_HOST_PREFIXES)})")
    by_path = F.lower(path(u)).rlike(f"^(?:{_alternation(AUTH_PATHS)})(?:/|$)")
    by_query = F.lower(query(u)).rlike(f"(?:{_alternation(AUTH_QUERY_KEYS)})=")
    return by_host | by_path | by_query


def is_aggregator_url(u: Column) -> Column:
    """FLT-02: news aggregator links that redirect to the real article."""
    return (host(u) == AGGREGATOR_HOST) & path(u).rlike("articles|read")


def is_feed_cdn_site(site: Column) -> Column:
    """FLT-15: a site address that is a feed host rather than a home page."""
    h = host(site)
    return h.isin(*FEED_CDN_HOSTS) | h.rlike(f"^(?:{_alternation(FEED_HOST_PREFIXES)})")


def normalize_url(u: Column) -> Column:
    """FN-01: library comparison key. Scheme, ``www.``, fragment and one trailing slash go;
    path case and query stay."""
    rest = F.regexp_replace(path(u), "/$", "")
    has_host = authority(u) != ""
    auth = F.regexp_replace(F.lower(authority(u)), r"^www\.", "")
    key = F.concat(
        F.when(has_host, F.concat(F.lit("//"), auth)).otherwise(F.lit("")),
        rest,
        F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise(F.lit("")),
    )
    return F.when(u.rlike(r"\s"), F.lower(u)).otherwise(key)


def normalize_feed_url(u: Column) -> Column:
    """FN-02: directory comparison key. All lower case, one trailing slash and the scheme go."""
    return F.regexp_replace(F.regexp_replace(F.lower(u), "/$", ""), "https?://", "")


def upgrade_https(u: Column) -> Column:
    """FN-03: only a leading ``http://`` changes."""
    return F.regexp_replace(u, "(?i)^http://", "https://")


def _remove_dot_segments(p: Column) -> Column:
    """RFC 3986 5.2.4 over the segment array of an absolute path."""
    parts = F.slice(F.split(p, "/"), F.lit(2), F.size(F.split(p, "/")))
    last = F.element_at(parts, -1)
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
    tail = F.when(last.isin(".", "..") & (F.size(kept) > 0), F.lit("/")).otherwise(F.lit(""))
    return F.when(p.rlike(r"/\.\.?(/|$)"), F.concat(joined, tail)).otherwise(p)


def resolve_url(base: Column, u: Column, upgrade: bool = True) -> Column:
    """FN-04: absolute address of ``u`` seen from ``base``; null for an empty reference."""
    b_scheme, b_auth, b_path = scheme(base), authority(base), path(base)
    root = F.concat(b_scheme, F.lit("://"), b_auth)
    u_path = path(u)
    tail = F.regexp_extract(u, r"([?#].*)$", 1)
    folder = F.when(b_path == "", F.lit("/")).otherwise(F.regexp_replace(b_path, "[^/]*$", ""))
    b_query = F.regexp_extract(base, r"(\?[^#]*)", 1)
    full = (
        F.when(u.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), u)
        .when(u.startswith("//"), F.concat(b_scheme, F.lit(":"), u))
        .when(u.startswith("/"), F.concat(root, _remove_dot_segments(u_path), tail))
        .when(u.startswith("?"), F.concat(root, b_path, tail))
        .when(u.startswith("#"), F.concat(root, b_path, b_query, tail))
        .otherwise(F.concat(root, _remove_dot_segments(F.concat(folder, u_path)), tail))
    )
    out = F.when((u.isNotNull()) & (u != ""), full)
    return upgrade_https(out) if upgrade else out


def display_domain(name: Column, u: Column) -> Column:
    """FN-05: attribution name, else the bare host."""
    return F.coalesce(F.nullif(name, F.lit("")), F.nullif(strip_www(host(u)), F.lit("")))


def bare_domain(site: Column) -> Column:
    """FN-06: host without ``www.`` and without its last label."""
    h = strip_www(host(site))
    return F.coalesce(
        F.when(h.contains("."), F.regexp_replace(h, r"\.[^.]*$", "")).otherwise(h), F.lit("")
    )


def deterministic_id(feed_url: Column) -> Column:
    """FN-07: UUID-shaped id from the first 16 digest bytes."""
    d = F.sha2(feed_url, 256)
    return F.concat_ws(
        "-", F.substring(d, 1, 8), F.substring(d, 9, 4), F.substring(d, 13, 4),
        F.substring(d, 17, 4), F.substring(d, 21, 12),
    )


def icon_site_candidates(site: Column) -> Column:
    """FN-28: the site, then its root host when the site sits on a feed host."""
    h = host(site)
    pattern = f"^(?:{_alternation(FEED_HOST_PREFIXES)})"
    root = F.concat(
        F.coalesce(F.nullif(scheme(site), F.lit("")), F.lit("https")), F.lit("://"),
        F.regexp_replace(h, pattern, ""),
    )
    return F.when(h.rlike(pattern), F.array(site, root)).otherwise(F.array(site))


def looks_like_url(text: Column) -> Column:
    """FLT-19: something a person may have typed as an address."""
    t = F.trim(text)
    return t.contains(".") & ~t.contains(" ")


def with_default_scheme(text: Column) -> Column:
    t = F.trim(text)
    return F.when(t.rlike("^(?i:https?)://"), t).otherwise(F.concat(F.lit("https://"), t))
