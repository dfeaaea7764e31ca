"""Language of web pages from fused evidence.

A page's posterior adds up the logarithms of
* the likelihood of its words and letter triples under each language's hashed multinomial,
  counted over all documents of known language;
* the language its markup declares, and the language its address suffix suggests, each as a
  confusion table learned from the pages' text alone;
* a prior of its host, smoothed towards its registered domain's, that towards the suffix's, and
  that towards the whole collection's: each level adds its parent's shares as ``STRENGTH``
  pages to its own counts.

Confusions and priors come from grouped aggregations of the text posteriors, which tasks
pre-aggregate: a host with a third of the pages is one row a task. All steps are native columns;
no page's html is ever shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.llm.common import keep
from feedloom.llm.quality_rules import let

BUCKETS = 1 << 13
STRENGTH = 5.0
# Words of a text weigh like so many independent ones at most: neighbours depend on each other.
EVIDENCE = 40.0
# Markup and code.
MARKUP = r"(?is)<(script|style|noscript|template)\b.*?(</\1\s*>|\z)|<!--.*?(-->|\z)|<[^>]*>"
# The same with controls, and parts that are the site's rather than the page's, where they are closed.
SITE = r"(?is)<(script|style|noscript|template)\b.*?(</\1\s*>|\z)|<(nav|footer|aside|select|option|button|textarea|label)\b.*?</\3\s*>|<(div|ins)\b[^>]*\bclass\s*=\s*[\"']?(?:[^\"'>]*\s)?ads?(?=[\s\"'>])[^>]*>.*?</\4\s*>|<!--.*?(-->|\z)|<[^>]*>"
# Suffixes that suggest a language; others suggest none.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "ar": "es", "uk": "en", "us": "en", "au": "en", "ie": "en",
            "it": "it", "pt": "pt", "br": "pt", "nl": "nl", "pl": "pl"}


def _features(text: Column) -> Column:
    """Buckets of a text's lower-case words, and of their letter triples with word ends."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D\p{P}\p{S}\p{N}]+")

    def triples(w: Column) -> Column:
        # Letters are taken apart once: a substring would search each from the word's beginning.
        return let(F.split(F.concat(F.lit("^"), w, F.lit("$")), ""), lambda m: F.transform(
            F.sequence(F.lit(0), F.size(m) - 3), lambda i: F.xxhash64(F.get(m, i), F.get(m, i + 1), F.get(m, i + 2))))

    def hashed(ws: Column) -> Column:
        return F.concat(F.transform(ws, lambda x: F.xxhash64(x)), F.flatten(F.transform(ws, triples)))

    grams = let(F.filter(words, lambda x: x != ""), hashed)
    return F.transform(grams, lambda g: F.pmod(g, F.lit(BUCKETS)).cast("int"))


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], list[list[float]]]:
    """Languages, and each bucket's log probability in each, one added to every count.

    Counted over all documents with a language. What returns is a row a bucket and language.
    """
    grams = docs.filter(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).alias("_lang"), _features(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("_grams"))
    # The outer form, and no filter after it: either would have the features made again.
    counts = grams.select("_lang", F.explode_outer("_grams").alias("_b")).groupBy("_lang", "_b").count().collect()
    counts = [r for r in counts if r["_b"] is not None]
    langs = sorted({r["_lang"] for r in counts})
    table = {g: [1] * BUCKETS for g in langs}
    for r in counts:
        table[r["_lang"]][r["_b"]] += r["count"]
    totals = {g: sum(table[g]) for g in langs}
    return langs, [[math.log(c / totals[g]) for c in table[g]] for g in langs]


def _constant(values: list[float]) -> Column:
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _normal(logs: Column) -> Column:
    """Probabilities from an array of logarithms."""
    return let(logs, lambda x: let(
        F.transform(x, lambda v: F.exp(v - F.array_max(x))),
        lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))))


def _text_logs(text: Column, weights: list[list[float]]) -> Column:
    """Log likelihood in each language, for at most ``EVIDENCE`` grams' worth."""
    def total(b: Column, w: list[float]) -> Column:
        weight = _constant(w)
        return F.aggregate(b, F.lit(0.0), lambda s, k: s + F.get(weight, k))

    def logs(b: Column) -> Column:
        scale = F.when(F.size(b) > 0, F.least(F.lit(1.0), F.lit(EVIDENCE) / F.size(b))).otherwise(F.lit(0.0))
        return F.array(*[total(b, w) * scale for w in weights])

    return let(_features(text), logs)


def text_of(html: Column) -> Column:
    """Text without controls and the site's parts; with them, where no letter is left."""
    def own(h: Column) -> Column:
        return let(F.regexp_replace(h, SITE, " "), lambda t: F.when(t.rlike(r"\p{L}"), t).otherwise(F.regexp_replace(h, MARKUP, " ")))

    return let(F.coalesce(html.cast("string"), F.lit("")), own)


def evidence(pages: DataFrame, html_col: str = "html", url_col: str = "url") -> dict[str, Column]:
    """Declared language, suffix, registered domain and host; empty where there is none."""
    declared = F.regexp_extract(F.coalesce(F.col(html_col).cast("string"), F.lit("")), r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})\b", 1)
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1))
    labels = F.split(host, r"\.")
    suffix = F.when(F.size(labels) > 1, F.element_at(labels, -1)).otherwise(F.lit(""))
    domain = F.when(F.size(labels) > 1, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host)
    return {"_declared": F.lower(declared), "_suffix": suffix, "_domain": domain, "_host": host}


def _sums(rows: DataFrame, keys: list[str], n: int, name: str) -> DataFrame:
    """Sums of the text posteriors by key, as an array."""
    return rows.groupBy(*keys).agg(F.array(*[F.sum(F.col("_p")[i]) for i in range(n)]).alias(name))


def _smoothed(own: Column, parent: Column) -> Column:
    """Shares of own counts with ``STRENGTH`` pages of the parent's shares added."""
    total = F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    return F.zip_with(own, parent, lambda x, p: (x + STRENGTH * p) / (total + STRENGTH))


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
             lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """One row a page: id, url, lang, probability, text_lang, declared_lang, host.

    Null and empty html leave the other evidence; a page without any gets the collection's most
    probable language. A null or odd url has the empty host, smoothed like any other; a declared
    language that no document has says nothing. Ties go to the first language by name. Repeated
    rows and null ids are kept; other columns are not read. Without documents of a known
    language, or without pages, the result has null languages, or no rows.
    """
    langs, weights = fit(docs, text_col, lang_col)
    n = len(langs)
    seen = evidence(pages, html_col, url_col)
    if not n:
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("probability", "double"), ("text_lang", "string"))]
        return pages.select(id_col, url_col, *nothing, seen["_declared"].alias("declared_lang"), seen["_host"].alias("host"))
    rows = keep(pages.select(
        F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), *[c.alias(k) for k, c in seen.items()],
        _text_logs(text_of(F.col(html_col)), weights).alias("_text")).withColumn("_p", _normal(F.col("_text"))))
    names = F.array(*[F.lit(g) for g in langs])
    one = [1.0 / n] * n
    # The collection's shares; a row of n numbers.
    total = rows.agg(*[F.coalesce(F.sum(F.col("_p")[i]), F.lit(0.0)) for i in range(n)]).first()
    shares = [(x + s * STRENGTH) / (sum(total) + STRENGTH) for x, s in zip(total, one)]
    base = F.array(*[F.lit(x) for x in shares])
    # Confusions of what is declared, and of what the suffix suggests, with the text's language;
    # each has at most as many keys as there are languages, and one for all others.
    hints = {"_declared": F.when(F.col("_declared").isin(langs), F.col("_declared")).otherwise(F.lit("")),
             "_suffix": F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv]), F.col("_suffix")), F.lit(""))}
    parts = []
    for key, hint in hints.items():
        table = {r["k"]: r["s"] for r in _sums(rows.select(hint.alias("k"), "_p"), ["k"], n, "s").collect()}
        said = F.array(*[F.lit(0.0)] * n)
        for k, s in table.items():
            # P(hint | language) up to what is alike for all: counts by language, one page added to each.
            if k:
                said = F.when(hint == k, F.array(*[F.lit(math.log((s[i] + 1) / (total[i] + n + 1))) for i in range(n)])).otherwise(said)
        parts.append(said)
    suffixes = _sums(rows, ["_suffix"], n, "_s1")
    domains = _sums(rows, ["_domain", "_suffix"], n, "_s2")
    hosts = _sums(rows, ["_host", "_domain", "_suffix"], n, "_s3")
    priors = (
        hosts.join(domains, ["_domain", "_suffix"]).join(suffixes, "_suffix")
        .withColumn("_q1", _smoothed(F.col("_s1"), base))
        .withColumn("_q2", _smoothed(F.col("_s2"), F.col("_q1")))
        .withColumn("_prior", _smoothed(F.col("_s3"), F.col("_q2"))).select("_host", "_prior")
    )
    logs = F.col("_text")
    for part in [*parts, F.transform("_prior", lambda x: F.log(x))]:
        logs = F.zip_with(logs, part, lambda a, b: a + b)
    fused = rows.join(priors, "_host").withColumn("_post", _normal(logs))
    return fused.select(
        F.col("_id").alias(id_col), F.col("_url").alias(url_col), _likeliest(F.col("_post"), names).alias("lang"),
        F.array_max("_post").alias("probability"), F.when(F.array_max("_text") != 0, _likeliest(F.col("_text"), names)).alias("text_lang"),
        F.nullif("_declared", F.lit("")).alias("declared_lang"), F.col("_host").alias("host"))


def _likeliest(values: Column, names: Column) -> Column:
    return F.get(names, (F.array_position(values, F.array_max(values)) - 1).cast("int"))
