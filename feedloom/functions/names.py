"""Feed names: shortening, directory simplification and search scoring."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from feedloom.functions import text, urls

# Title separators, terms that never are a brand, and search weights.
SPACED_SEPARATORS = ("|", "–", "—", "·", "•", "»")
SEPARATORS = ("-", "–", "—", "|", ">", ":", "·", "•", "»")
TITLE_SEPARATORS = ("-", "–", "—", "|", ">", ":", "·", "•")
GENERIC_TERMS = (
    "blog", "blogs", "news", "page array", "rss feed", "rss", "feed",
    "podcast", "home", "latest news", "blog feed", "top stories",
)
SEARCH_WEIGHTS = {
    "name_prefix": 100, "name": 80, "domain_equal": 90, "domain": 70,
    "tag_prefix": 60, "category": 40, "country": 40, "description": 20,
}


def _strip_punct(w: Column) -> Column:
    return F.regexp_replace(w, r"^\p{P}+|\p{P}+$", "")


def _words(s: Column) -> Column:
    return F.filter(F.split(s, " "), lambda w: w != "")


def _reach(cleaned: Column, stop_len: Column) -> Column:
    """Words a run may span: each adds a letter, except those that were all punctuation."""
    return stop_len + F.size(F.filter(cleaned, lambda w: w == ""))


def _run_match(cleaned: Column, labels: list[Column], stop_len: Column, reach: Column) -> Column:
    """First run of adjacent words that joins to a label, as struct(start, n); else null.

    A run ends once it is as long as the label, so each start looks at ``reach`` words only.
    """
    empty = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("state"))

    def step(acc: Column, w: Column) -> Column:
        c = F.concat(acc["c"], w)
        hit = c == labels[0]
        for label in labels[1:]:
            hit = hit | (c == label)
        state = F.when(hit, F.lit(1)).when(F.length(c) >= stop_len, F.lit(2)).otherwise(F.lit(0))
        nxt = F.struct(c.alias("c"), (acc["n"] + 1).alias("n"), state.alias("state"))
        return F.when(acc["state"] == 0, nxt).otherwise(acc)

    def at(i: Column) -> Column:
        end = F.aggregate(F.slice(cleaned, i, reach), empty, step)
        return F.struct(i.alias("start"), end["n"].alias("n"), (end["state"] == 1).alias("hit"))

    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(cleaned), F.lit(1))), at)
    return F.get(F.filter(runs, lambda r: r["hit"]), F.lit(0))


def with_simple_name(df: DataFrame, name: str, feed_url: str, out: str = "simple_name") -> DataFrame:
    """FN-09: brand name of a verbose feed title.

    Steps are separate projections so that each array is built once per row.
    """
    keep = df.columns
    norm = text.trim_ws(F.col(name))
    for sep in SPACED_SEPARATORS:
        norm = F.replace(norm, F.lit(sep), F.lit(f" {sep} "))
    norm = F.trim(F.regexp_replace(norm, " {2,}", " "))
    label = F.regexp_replace(urls.host(F.col(feed_url)), r"www\.|feeds\.", "")
    d = df.select("*", norm.alias("_n"), F.coalesce(F.substring_index(label, ".", 1), F.lit("")).alias("_d"))
    d = d.select("*", _words(F.col("_n")).alias("_w"), F.replace("_d", F.lit("-"), F.lit("")).alias("_dh"))
    d = d.select(
        "*",
        F.transform("_w", lambda w: _strip_punct(w)).alias("_bare"),
        (F.array_position(F.transform("_w", lambda w: w.isin(*SEPARATORS)), F.lit(True)) - 1)
        .cast("int").alias("_sep"),
    )
    has_sep = F.col("_sep") > 0
    none = F.array().cast("array<string>")
    d = d.select(
        "*",
        F.transform("_bare", lambda w: F.lower(w)).alias("_clean"),
        F.when(has_sep, F.filter(F.slice("_bare", F.lit(1), F.col("_sep")), lambda w: w != ""))
        .otherwise(none).alias("_before"),
        F.when(has_sep, F.filter(F.slice("_bare", F.col("_sep") + 2, F.size("_w")), lambda w: w != ""))
        .otherwise(none).alias("_after"),
    )
    d = d.select("*", _reach(F.col("_clean"), F.length("_d")).alias("_span"))
    d = d.select(
        "*",
        F.array_join("_before", " ").alias("_bj"), F.array_join("_after", " ").alias("_aj"),
        F.lower(F.array_join("_before", "")).alias("_bc"),
        F.lower(F.array_join("_after", "")).alias("_ac"),
        F.array_position(
            F.transform("_clean", lambda w: (w == F.col("_d")) | (w == F.col("_dh"))), F.lit(True)
        ).alias("_hit"),
        F.when(
            (F.size("_w") > 5) & (F.col("_d") != ""),
            _run_match(F.col("_clean"), [F.col("_d"), F.col("_dh")], F.length("_d"), F.col("_span")),
        ).alias("_run"),
        F.filter(
            F.transform(F.filter("_w", lambda w: ~w.isin(*SEPARATORS)), lambda w: _strip_punct(w)),
            lambda w: w != "",
        ).alias("_real"),
    )
    labelled = F.col("_d") != ""
    matches = lambda c: (F.col(c) == F.col("_d")) | (F.col(c) == F.col("_dh"))
    result = (
        F.when(F.col("_n") == "", F.col("_n"))
        .when(has_sep & (F.size("_after") > 0) & F.lower("_bj").isin(*GENERIC_TERMS), F.col("_aj"))
        .when(has_sep & (F.size("_before") > 0) & F.lower("_aj").isin(*GENERIC_TERMS), F.col("_bj"))
        .when(has_sep & labelled & matches("_ac"), F.col("_aj"))
        .when(has_sep & labelled & matches("_bc"), F.col("_bj"))
        .when((F.size("_w") <= 5) | ~labelled, F.col("_n"))
        .when(F.col("_hit") > 0, F.try_element_at("_bare", F.col("_hit").cast("int")))
        .when(F.col("_run").isNotNull(),
              F.array_join(F.slice("_bare", F.col("_run.start"), F.col("_run.n")), " "))
        .when(has_sep & F.size("_before").between(1, 4), F.col("_bj"))
        .otherwise(F.array_join(F.slice("_real", 1, 3), " "))
    )
    return d.select(*keep, result.alias(out))


def with_short_title(df: DataFrame, title: str, url: str, out: str = "short_title") -> DataFrame:
    """FN-10: titles above five words shrink to the site's name, else to three words."""
    keep = df.columns
    label = F.regexp_replace(urls.host(F.col(url)), r"www\.", "")
    d = df.select(
        "*", text.trim_ws(F.col(title)).alias("_raw"),
        F.coalesce(F.substring_index(label, ".", 1), F.lit("")).alias("_d"),
    )
    d = d.select("*", _words(F.col("_raw")).alias("_w"))
    d = d.select("*", F.transform("_w", lambda w: _strip_punct(w)).alias("_bare"))
    d = d.select("*", F.transform("_bare", lambda w: F.lower(w)).alias("_clean"))
    d = d.select("*", _reach(F.col("_clean"), F.length("_d")).alias("_span"))
    strip = "^[–—|>:·•]+|[–—|>:·•]+$"
    d = d.select(
        "*",
        F.array_position("_clean", F.col("_d")).alias("_hit"),
        F.when(
            (F.size("_w") > 5) & (F.col("_d") != ""),
            _run_match(F.col("_clean"), [F.col("_d")], F.length("_d"), F.col("_span")),
        ).alias("_run"),
        F.filter(
            F.transform(
                F.filter("_w", lambda w: ~w.isin(*TITLE_SEPARATORS)),
                lambda w: F.regexp_replace(w, strip, ""),
            ),
            lambda w: w != "",
        ).alias("_real"),
    )
    result = (
        F.when(F.size("_w") <= 5, F.col("_raw"))
        .when((F.col("_d") != "") & (F.col("_hit") > 0),
              F.try_element_at("_bare", F.col("_hit").cast("int")))
        .when(F.col("_run").isNotNull(),
              F.array_join(F.slice("_bare", F.col("_run.start"), F.col("_run.n")), " "))
        .otherwise(F.array_join(F.slice("_real", 1, 3), " "))
    )
    return d.select(*keep, result.alias(out))


def search_score(
    query: str, name: Column, site_url: Column, tags: Column,
    category: Column, country: Column, description: Column,
) -> Column:
    """FN-26: summed weights over the query terms, by prefix and substring only."""
    terms = [t for t in query.lower().split(" ") if t]
    n, dom = F.lower(name), urls.bare_domain(site_url)
    w = SEARCH_WEIGHTS
    zero = F.lit(0)
    total = zero
    for term in terms:
        t = F.lit(term)
        total = (
            total
            + F.when(n.startswith(t), w["name_prefix"]).when(n.contains(t), w["name"]).otherwise(zero)
            + F.when(dom == "", zero).when(dom == t, w["domain_equal"])
            .when(dom.contains(t), w["domain"]).otherwise(zero)
            + F.when(F.exists(tags, lambda x: F.lower(x).startswith(t)), w["tag_prefix"]).otherwise(zero)
            + F.when(F.lower(category).contains(t), w["category"]).otherwise(zero)
            + F.when(F.lower(country).contains(t), w["country"]).otherwise(zero)
            + F.when(F.lower(description).contains(t), w["description"]).otherwise(zero)
        )
    return total
