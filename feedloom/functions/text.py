"""Text, time and reading-time column functions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, functions as F

# Markers counted in raw pages as signs of a paywall.
PAYWALL_TERMS = (
    "paywall", "regwall", "subscribe-wall", "metered-content", "paid-content", "premium-content",
)
FEED_MARKERS = ("<?xml", "<rss", "<feed", "<opml")
FEED_SNIFF_CHARS = 1000

# Unicode white space, by the class flag: several times faster than a spelled-out class.
VISIBLE = r"(?U)\S"
SPACES = r"(?U)\s+"



def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.

    A lambda that mentions an outer expression evaluates it again for every element; bound to
    a lambda variable it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def trim_ws(s: Column) -> Column:
    """Strip any Unicode white space and line breaks from both ends."""
    return F.regexp_replace(s, r"(?U)^\s+|(?<!\s)\s+$", "")


def word_count(s: Column) -> Column:
    """AGG-12: white-space separated tokens."""
    return F.regexp_count(s, F.lit(f"{VISIBLE}+"))


def reading_minutes(words: Column) -> Column:
    """FN-14: 200 words a minute, rounded up, at least one."""
    return F.greatest(F.lit(1), F.floor((words + 199) / 200).cast("int"))


def format_minutes(m: Column) -> Column:
    """FN-15: condensed total, in five-minute steps above ten."""
    five = (F.floor((m + 2) / 5) * 5).cast("int")
    shown = F.when(m < 10, m.cast("int")).otherwise(five)
    hours = F.floor(shown / 60).cast("int").cast("string")
    rest = (shown % 60).cast("string")
    return (
        F.when(m <= 0, F.lit(None).cast("string"))
        .when(m < 5, F.lit("5min"))
        .when(m >= 300, F.lit("5hr+"))
        .when(shown < 60, F.concat(shown.cast("string"), F.lit("min")))
        .when(shown % 60 == 0, F.concat(hours, F.lit("hr")))
        .otherwise(F.concat(hours, F.lit("hr "), rest, F.lit("min")))
    )


def minutes_label(m: Column) -> Column:
    return F.concat(m.cast("int").cast("string"), F.lit(" min read"))


def relative_time(ts: Column, now: Column, prefix: str | None = None) -> Column:
    """FN-16: age of a moment in words; ``now`` is a parameter so that runs repeat."""
    seconds = F.unix_micros(now) - F.unix_micros(ts)
    micro = 1_000_000
    days = F.datediff(F.to_date(now), F.to_date(ts))
    date = F.date_format(ts, "MMM d, yyyy")
    if prefix is not None:
        date = F.concat(F.lit(prefix + " "), date)

    def ago(unit_micros: int, suffix: str) -> Column:
        n = F.floor(seconds / unit_micros).cast("bigint").cast("string")
        return F.concat(n, F.lit(suffix))

    return (
        F.when(seconds < 0, date)
        .when(seconds < 60 * micro, F.lit("Just now"))
        .when(seconds < 3600 * micro, ago(60 * micro, "m ago"))
        .when(seconds < 86400 * micro, ago(3600 * micro, "h ago"))
        .when(days == 1, F.lit("Yesterday"))
        .when(days.between(2, 6), F.concat(days.cast("string"), F.lit(" days ago")))
        .otherwise(date)
    )


def parse_feed_date(s: Column, without_seconds: bool = False) -> Column:
    """FN-11: ISO 8601 with or without fraction, or RFC 822; null when neither fits."""
    t = F.trim(s)
    iso = F.when(
        t.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"),
        F.try_to_timestamp(F.regexp_replace(t, r"([+-]\d{2})(\d{2})$", "$1:$2")),
    )
    # Weekday names do not parse in Spark and carry no information.
    bare = F.regexp_replace(t, r"^[A-Za-z]{3},\s+", "")
    rfc = [
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [A-Z]{1,5}$"),
               F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss z"))),
        F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"),
               F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z"))),
    ]
    if without_seconds:
        rfc += [
            F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} [A-Z]{1,5}$"),
                   F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm z"))),
            F.when(bare.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2} [+-]\d{4}$"),
                   F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z"))),
        ]
    return F.coalesce(iso, *rfc)


def _decode_numeric(s: Column) -> Column:
    """Replace ``&#n;`` and ``&#xh;`` references that occur in the text."""
    codes = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(&#(?:[xX][0-9a-fA-F]{1,6}|[0-9]{1,7});)")))

    def one(acc: Column, ref: Column) -> Column:
        digits = F.regexp_extract(ref, r"&#[xX]?([0-9a-fA-F]+);", 1)
        is_hex = ref.rlike("^&#[xX]")
        code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("int")
        # UTF-32BE bytes of the code point read back as text; chr() stops at 255.
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        valid = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        return F.when(valid, F.replace(acc, ref, char)).otherwise(acc)

    return F.when(F.size(codes) > 0, F.aggregate(codes, s, one)).otherwise(s)


def _decode_named(s: Column) -> Column:
    """Replace the named references that occur; the ampersand's own name is left alone."""
    # One literal for the whole table; Spark folds it to a constant map.
    pairs = "\u0001".join(f"&{name};\u0002{chr(code)}" for name, code in name2codepoint.items())
    table = F.str_to_map(F.lit(pairs + "\u0001&apos;\u0002'"), F.lit("\u0001"), F.lit("\u0002"))
    refs = F.array_distinct(F.regexp_extract_all(s, F.lit(r"(&[A-Za-z][A-Za-z0-9]{1,31};)")))
    refs = F.filter(refs, lambda r: r != "&amp;")
    return F.when(
        F.size(refs) > 0,
        F.aggregate(
            refs, s, lambda acc, r: F.replace(acc, r, F.coalesce(F.try_element_at(table, r), r))
        ),
    ).otherwise(s)


def unescape(s: Column) -> Column:
    """Numeric references, named ones, and the ampersand last so nothing decodes twice."""
    return F.replace(_decode_named(_decode_numeric(s)), F.lit("&amp;"), F.lit("&"))


def decode_entities(s: Column) -> Column:
    """FN-12: plain text of a marked-up title; untouched when nothing needs decoding."""
    plain = F.regexp_replace(s, r"<[^>]*>", "")
    return F.when(s.contains("&") | s.contains("<"), trim_ws(unescape(plain))).otherwise(s)


def escape_html(s: Column) -> Column:
    """FN-23: the ampersand goes first."""
    out = F.replace(s, F.lit("&"), F.lit("&amp;"))
    out = F.replace(out, F.lit("<"), F.lit("&lt;"))
    out = F.replace(out, F.lit(">"), F.lit("&gt;"))
    return F.replace(out, F.lit('"'), F.lit("&quot;"))


# Fixed value: used where no page template is configured.
DEFAULT_TEMPLATE = "<html><body><h1>{{TITLE}}</h1>{{BODY_HTML}}</body></html>"


def render_page(title: Column, body: Column, template: str = DEFAULT_TEMPLATE) -> Column:
    """FN-24: fill the page template; the title is escaped, the body is not."""
    out = F.replace(F.lit(template), F.lit("{{TITLE}}"), escape_html(title))
    return F.replace(out, F.lit("{{BODY_HTML}}"), body)


def fix_bare_ampersands(s: Column) -> Column:
    """SRC-05: only five named references and numeric ones keep their ampersand."""
    return F.regexp_replace(s, r"&(?!(?:amp|lt|gt|quot|apos);|#)", "&amp;")


def add_paragraphs(s: Column) -> Column:
    """FN-22: paragraphs from blank lines, else lines, else every three sentences."""

    def chunks(sep: str) -> Column:
        return F.filter(F.transform(F.split(s, sep), trim_ws), lambda x: x != "")

    def wrap(parts: Column) -> Column:
        return F.array_join(
            F.transform(parts, lambda p: F.concat(F.lit("<p>"), p, F.lit("</p>"))), "\n"
        )

    def by_sentence(sentences: Column) -> Column:
        groups = F.transform(
            F.sequence(F.lit(1), F.size(sentences), F.lit(3)),
            lambda i: F.array_join(F.slice(sentences, i, 3), " "),
        )
        return F.when(F.size(sentences) > 1, wrap(F.filter(groups, lambda g: g != ""))).otherwise(
            wrap(F.array(s))
        )

    sentences = F.transform(F.split(s, r"(?<=[.!?])\s+(?=[A-Z])"), lambda x: F.trim(x))
    return let(chunks(r"\n\n"), lambda blank: F.when(F.size(blank) > 1, wrap(blank)).otherwise(
        let(chunks(r"\n"), lambda lines: F.when(F.size(lines) > 1, wrap(lines)).otherwise(
            let(sentences, by_sentence)))))


def paywall_score(html: Column) -> Column:
    """AGG-13: occurrences of the paywall terms in the raw page."""
    # No term is a prefix of another one, so one pass over the alternation counts them all.
    return F.regexp_count(F.lower(html), F.lit("|".join(PAYWALL_TERMS)))


def looks_like_feed(body: Column) -> Column:
    """FLT-08: the sniffing window is part of the rule, as in browsers."""
    head = F.lower(F.substring(body, 1, FEED_SNIFF_CHARS))
    hit = head.contains(FEED_MARKERS[0])
    for marker in FEED_MARKERS[1:]:
        hit = hit | head.contains(marker)
    return F.coalesce(hit, F.lit(False))


def slugify(name: Column, ascii_only: bool = False) -> Column:
    """FN-08: category slug; the ASCII form drops accented letters instead of keeping them."""
    if ascii_only:
        s = F.regexp_replace(F.lower(name), r"[^a-z0-9\s-]", "")
        s = F.regexp_replace(F.trim(s), r"\s+", "-")
    else:
        s = F.regexp_replace(F.lower(name), r"[^\p{L}\p{M}\p{N} -]", "")
        s = F.regexp_replace(F.trim(s), " +", "-")
    return F.regexp_replace(s, "-{2,}", "-")


def meta_description(html: Column) -> Column:
    """FN-20: og:description, else description, attributes in either order."""
    value = r"""content=["']([^"']*)["']"""

    def pick(attr: str, first: bool) -> Column:
        pattern = (
            rf"(?is)<meta[^>]+{attr}[^>]+{value}" if first else rf"(?is)<meta[^>]+{value}[^>]+{attr}"
        )
        return F.nullif(trim_ws(F.regexp_extract(html, pattern, 1)), F.lit(""))

    og, plain = r"""property=["']og:description["']""", r"""name=["']description["']"""
    return unescape(
        F.coalesce(pick(og, True), pick(og, False), pick(plain, True), pick(plain, False))
    )


# Boilerplate removed from feed descriptions, and terms that disqualify one.
DESCRIPTION_JUNK = (
    "This feed is for non commercial use.", "FOR PERSONAL USE ONLY", "Content Copyright",
    "Default RSS Feed", "RSS Feed", " - Medium", "Kinja RSS",
)
DESCRIPTION_BLOCKLIST = (
    "bonanza", "gambling", "casino", "slot", "suspect believed", "get each month",
    "responsive blogger", "shah code exporters", "brad feld", "bruno rocha",
    "latest updates read my", "kicked off celebrations",
)


def _tidy_description(raw: Column, junk) -> Column:
    out = trim_ws(raw)
    for phrase in junk:
        out = trim_ws(F.replace(out, F.lit(phrase), F.lit("")))
    out = F.trim(F.regexp_replace(out, SPACES, " "))
    cut = F.substring(out, 1, 120)
    last_space = F.length(cut) - F.length(F.substring_index(cut, " ", -1)) - 1
    cut = F.when(last_space > 60, F.substring(cut, F.lit(1), last_space)).otherwise(cut)
    cut = F.regexp_replace(cut, "[.,;:\\- ]+$", "")
    out = F.when(F.length(out) > 120, cut).otherwise(out)
    return F.regexp_replace(out, r"\.+$", "")


def refine_description(current: Column, og: Column) -> Column:
    """FN-21: the fetched text when long enough, else the present one; then cleaned."""
    cur, o = F.coalesce(current, F.lit("")), F.coalesce(og, F.lit(""))
    fallback = F.when(cur != "", cur).otherwise(o)
    raw = (
        F.when((F.length(o) > 10) & ~F.lower(o).startswith("http"), o)
        .when(F.length(cur) > 10, cur)
        .otherwise(F.when(o != "", o).otherwise(cur))
    )
    raw = F.when(F.length(trim_ws(raw)) < 5, fallback).otherwise(raw)
    return _tidy_description(raw, DESCRIPTION_JUNK)


def pick_description(
    name: Column, current: Column, og: Column, override: Column, prefer_current: Column
) -> Column:
    """FN-21: stricter choice with a manual override, a preference flag and a blocklist."""
    cur, o = F.coalesce(current, F.lit("")), F.coalesce(og, F.lit(""))
    blocked = F.lower(o).rlike("|".join(DESCRIPTION_BLOCKLIST))
    raw = (
        F.when(prefer_current & (F.length(cur) > 10), cur)
        .when((F.length(o) > 15) & ~blocked, o)
        .when(F.length(cur) > 5, cur)
        .otherwise(F.when(o != "", o).otherwise(cur))
    )
    junk = tuple(j for j in DESCRIPTION_JUNK if j != "RSS Feed")
    return F.coalesce(override, _tidy_description(raw, junk))
