"""Tree operations over the node table, as windows and groupings keyed by page.

A node's subtree is the interval ``pre..last``, and intervals nest. So "inside an X" is a
running maximum of X's ``last``, and "contains an X" is a look ahead to the next X. Both are
window expressions on one order, which Spark evaluates with a single sort per page. No step
joins nodes with themselves: that would work out all rules before it twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from feedloom.functions import text as T



def page_order() -> WindowSpec:
    return Window.partitionBy("page_id").orderBy("pre")


def before_node() -> WindowSpec:
    return page_order().rowsBetween(Window.unboundedPreceding, -1)


def up_to_node() -> WindowSpec:
    return page_order().rowsBetween(Window.unboundedPreceding, 0)


NODE_COLUMNS = ["page_id", "pre", "last", "parent", "path", "tag", "attrs", "text"]

# Columns are made on demand: they belong to the session that is active when they are used.
def node_tag() -> Column:
    return F.col("tag")


def is_text() -> Column:
    return node_tag() == "#text"


def is_element() -> Column:
    return node_tag() != "#text"


def non_blank() -> Column:
    """Text nodes with something to see. The search stops at the first visible character."""
    return is_text() & F.col("text").rlike(T.VISIBLE)



# No interface phrase is longer, once trimmed; a longer text is none and need not be kept.
PHRASE_CHARS = 64


def attr(name: str, default: str = "") -> Column:
    """Attribute value, empty when absent."""
    return F.coalesce(F.try_element_at("attrs", F.lit(name)), F.lit(default))


def has_attr(name: str) -> Column:
    return F.coalesce(F.map_contains_key("attrs", name), F.lit(False))


def set_attrs(values: dict[str, Column], attrs: Column | None = None) -> Column:
    a = F.col("attrs") if attrs is None else attrs
    kept = F.map_filter(a, lambda k, _: ~k.isin(*values))
    added = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.map_concat(kept, added)


def drop_attrs(names, attrs: Column | None = None) -> Column:
    a = F.col("attrs") if attrs is None else attrs
    return F.map_filter(a, lambda k, _: ~k.isin(*names))


def inside(cond: Column) -> Column:
    """True for nodes with a proper ancestor that satisfies ``cond``."""
    return F.coalesce(F.max(F.when(cond, F.col("last"))).over(before_node()) >= F.col("pre"), F.lit(False))


def look_ahead(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """Add the first value that is not null among the nodes after each one.

    ``lead`` goes on from where it found the last value, so a page is read once, whatever its
    length. A frame up to the end of the page would be read anew for every node.
    """
    ahead = "lead(`_given_{}`) IGNORE NULLS OVER (PARTITION BY page_id ORDER BY pre)"
    d = nodes.withColumns({f"_given_{n}": v for n, v in values.items()})
    return d.withColumns({n: F.expr(ahead.format(n)) for n in values}).drop(*[f"_given_{n}" for n in values])


def with_contains(nodes: DataFrame, conds: dict[str, Column]) -> DataFrame:
    """Add whether a node has a descendant that satisfies each condition."""
    d = look_ahead(nodes, {n: F.when(c, F.col("pre")) for n, c in conds.items()})
    return d.withColumns({n: F.coalesce(F.col(n) <= F.col("last"), F.lit(False)) for n in conds})


def nearest(cond: Column, value: Column) -> Column:
    """``value`` of the latest node before this one that satisfies ``cond``, if it encloses it.

    Exact for elements that cannot nest in their own kind, such as links and pictures.
    """
    latest = F.last(
        F.when(cond, F.struct(F.col("last").alias("last"), value.alias("v"))), ignorenulls=True
    ).over(before_node())
    return F.when(latest["last"] >= F.col("pre"), latest["v"])


def with_first_within(nodes: DataFrame, firsts: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Add by name the value of the first descendant that satisfies a condition."""
    d = look_ahead(nodes, {n: F.when(c, F.struct(F.col("pre").alias("pre"), v.alias("v"))) for n, (c, v) in firsts.items()})
    return d.withColumns({n: F.when(F.col(f"{n}.pre") <= F.col("last"), F.col(f"{n}.v")) for n in firsts})


def prune(nodes: DataFrame, cond: Column) -> DataFrame:
    """Remove the nodes that satisfy ``cond``, with all they contain."""
    end = F.max(F.when(F.coalesce(cond, F.lit(False)), F.col("last"))).over(up_to_node())
    return (
        nodes.withColumn("_end", end)
        .filter(F.col("_end").isNull() | (F.col("_end") < F.col("pre")))
        .drop("_end")
    )


def unwrap(nodes: DataFrame, cond: Column) -> DataFrame:
    """Remove the elements that satisfy ``cond`` and keep what they contain.

    Only nodes inside a removed element look for it in their path.
    """
    hit = F.coalesce(cond, F.lit(False))
    marked = nodes.withColumn("_hit", hit).withColumn("_within", inside(F.col("_hit")))
    gone = F.collect_set(F.when(F.col("_hit"), F.col("pre"))).over(Window.partitionBy("page_id"))
    marked = marked.withColumn("_gone", gone).filter(~F.col("_hit"))
    path = F.when(F.col("_within"), F.array_except("path", "_gone")).otherwise(F.col("path"))
    return (
        marked.withColumn("path", path)
        .withColumn("parent", F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(-1)))
        .drop("_hit", "_gone", "_within")
    )


def subtree_sums(nodes: DataFrame, values: dict[str, Column], where: Column | None = None) -> DataFrame:
    """Add sums over each node and all its descendants; null for nodes outside ``where``.

    A node is an event where it starts and one, without its content, where its subtree ends. A
    running sum over a page's events, read at both, gives the subtree's sum, whatever the depth.
    Sorted by node, the end comes right after the start. Nodes are already hashed by page, so
    nothing is shuffled.
    """
    begin = F.struct(F.col("pre").alias("at"), F.lit(0).alias("end"))
    close = F.struct(F.col("last").alias("at"), F.lit(1).alias("end"))
    both = F.array(begin, close)
    kept = [c for c in nodes.columns if c not in ("page_id", "pre", *values)]
    events = nodes.withColumns({n: F.coalesce(c, F.lit(0)) for n, c in values.items()}).withColumn(
        "_e", F.explode(both if where is None else F.when(where, both).otherwise(F.array(begin))))
    starts = F.col("_e.end") == 0
    events = events.select("page_id", "pre", "_e", *[F.when(starts, F.col(n)).otherwise(0).alias(n) for n in values],
                           *[F.when(starts, F.col(c)).alias(c) for c in kept])
    order = Window.partitionBy("page_id").orderBy("_e.at", "_e.end").rowsBetween(Window.unboundedPreceding, 0)
    events = events.withColumns({f"_run_{n}": F.sum(n).over(order) for n in values})
    ends = F.lead(F.struct("pre", *[f"_run_{n}" for n in values])).over(Window.partitionBy("page_id").orderBy("pre", "_e.end"))
    events = events.withColumn("_end", ends).filter(starts)
    # What came up to the end, less what came before the start.
    return events.select("page_id", "pre", *kept, *[
        F.when(F.col("_end.pre") == F.col("pre"), F.col(f"_end._run_{n}") - F.col(f"_run_{n}") + F.col(n)).alias(n) for n in values])


def near_sums(nodes: DataFrame, value: Column, names: tuple[str, ...]) -> DataFrame:
    """Add sums of ``value`` over the nodes one level below, two levels below, and so on.

    A node with a value stands beside itself once for each level, under the number of its
    ancestor there.
    """
    at = lambda pre, level: F.struct(pre.alias("pre"), level.alias("level"))
    itself = F.array(at(F.col("pre"), F.lit(-1)))
    above = F.transform(F.slice(F.reverse("path"), 1, len(names)), at)
    rows = nodes.withColumn("_v", value)
    rows = rows.withColumn("_at", F.explode(F.when(F.col("_v").isNotNull(), F.concat(itself, above)).otherwise(itself)))
    group = Window.partitionBy("page_id", "_at.pre")
    sums = {n: F.sum(F.when(F.col("_at.level") == k, F.col("_v"))).over(group) for k, n in enumerate(names)}
    return rows.withColumns(sums).filter(F.col("_at.level") == -1).drop("_v", "_at")


# Statistics of children that a rule may ask for, besides its own counts.
COUNTS = ("n_el", "n_img", "n_txt")


def child_stats(nodes: DataFrame, names: tuple[str, ...] = COUNTS, allowed: dict[str, Column] | None = None) -> DataFrame:
    """Per element: child elements ``n_el``, child images ``n_img``, non-blank child texts
    ``n_txt`` and the greatest short one ``own_text``, as far as they are asked for.

    ``allowed`` adds counts of child elements that satisfy further conditions. The counts are
    taken among siblings; the first child, which is the next row of the page, hands them up.
    """
    siblings = Window.partitionBy("page_id", "parent")
    known = {
        "n_el": lambda: F.count_if(is_element()), "n_img": lambda: F.count_if(node_tag() == "img"), "n_txt": lambda: F.count_if(non_blank()),
        "own_text": lambda: F.max(F.when(non_blank() & (F.length(T.trim_ws(F.col("text"))) <= PHRASE_CHARS), T.trim_ws(F.col("text")))),
    }
    stats = {n: known[n]() for n in names} | {n: F.count_if(is_element() & cond) for n, cond in (allowed or {}).items()}
    d = nodes.withColumn("_up", F.struct("parent", *[c.over(siblings).alias(n) for n, c in stats.items()]))
    d = d.withColumn("_down", F.lead("_up").over(page_order()))
    mine = F.col("_down.parent") == F.col("pre")
    out = {
        n: F.when(mine, F.col(f"_down.{n}")) if n == "own_text"
        else F.coalesce(F.when(mine, F.col(f"_down.{n}")), F.lit(0))
        for n in stats
    }
    return d.select(*nodes.columns, *[c.alias(n) for n, c in out.items()])


def with_parent(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """JOIN-16 for one level: values of the parent element.

    A left join without one: an element stands among its children, too, without its content, and
    all read its values from there. A node has a row for each element that bears its parent's number.
    """
    itself, above = F.struct(F.col("parent").alias("pre"), F.lit(False).alias("up")), F.struct("pre", F.lit(True).alias("up"))
    rows = nodes.withColumn("_values", F.struct(*[c.alias(n) for n, c in values.items()]))
    rows = rows.withColumn("_at", F.explode(F.when(is_element(), F.array(itself, above)).otherwise(F.array(itself))))
    up = F.col("_at.up")
    rows = rows.select("page_id", "_at", F.when(up, F.col("_values")).alias("_values"),
                       *[F.when(~up, F.col(c)).alias(c) for c in nodes.columns if c != "page_id"])
    found = F.collect_list("_values").over(Window.partitionBy("page_id", "_at.pre"))
    rows = rows.withColumn("_found", F.when(F.col("page_id").isNotNull(), found)).filter(~up)
    rows = rows.withColumn("_values", F.explode_outer("_found"))
    return rows.select(*nodes.columns, *[F.col(f"_values.{n}").alias(n) for n in values])


def insert(nodes: DataFrame, extra: DataFrame) -> DataFrame:
    """Nodes with further rows of the same columns, for pages that have nodes.

    They come as one list a page and are dealt out at its first node: a union would hash all
    nodes anew. ``extra`` must be small for each page.
    """
    own = [c for c in nodes.columns if c != "page_id"]
    lists = extra.groupBy("page_id").agg(F.collect_list(F.struct(*own)).alias("_extra"))
    rows = nodes.withColumn("_first", F.row_number().over(page_order()) == 1).join(lists, "page_id", "left")
    rows = rows.withColumn("_extra", F.when(F.col("_first"), F.col("_extra")))
    more = F.when(F.col("_extra").isNotNull(), F.sequence(F.lit(-1), F.size("_extra") - 1))
    rows = rows.withColumn("_i", F.explode(F.coalesce(more, F.array(F.lit(-1)))))
    new = F.get("_extra", F.col("_i"))
    return rows.select("page_id", *[F.when(F.col("_i") < 0, F.col(c)).otherwise(new[c]).alias(c) for c in own])


def ancestors(nodes: DataFrame, which: Column, k: int | None, values: dict[str, Column]) -> DataFrame:
    """JOIN-16: for chosen nodes, one row per ancestor, within ``k`` levels if given, nearest first."""
    up = F.reverse("path") if k is None else F.slice(F.reverse("path"), 1, k)
    chosen = nodes.filter(which).select("page_id", "pre", F.posexplode(up).alias("level", "_anc"))
    up = nodes.filter(is_element()).select(
        "page_id", F.col("pre").alias("_anc"), *[c.alias(n) for n, c in values.items()]
    )
    return chosen.join(up, ["page_id", "_anc"]).withColumn("level", F.col("level") + 1).drop("_anc")


# Elements that break a line of text.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "br", "dd", "details", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "header", "hr", "li", "main", "nav", "ol", "p", "pre", "section", "table", "tbody", "td",
    "tfoot", "th", "thead", "tr", "ul", "body", "html", "picture",
)
VOID_TAGS = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr")


def open_tag(tag: Column, attrs: Column) -> Column:
    pairs = F.transform(
        F.map_entries(attrs),
        lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), T.escape_html(e["value"]), F.lit('"')),
    )
    return F.concat(F.lit("<"), tag, F.array_join(pairs, ""), F.lit(">"))


def render(nodes: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Serialize each page's nodes: ``html`` and white-space normalized ``plain`` text.

    A page is one document, so gathering its pieces is bounded by the document. The optional
    ``wrap`` column puts an image into its own paragraph.
    """
    has_wrap = "wrap" in nodes.columns
    wrap = F.coalesce(F.col("wrap"), F.lit(False)) if has_wrap else F.lit(False)
    space = F.when(node_tag().isin(*BLOCK_TAGS), F.lit(" ")).otherwise(F.lit(""))
    escaped = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")),
                                  F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    opening = F.concat(F.when(wrap, F.lit("<p>")).otherwise(F.lit("")), open_tag(node_tag(), F.col("attrs")),
                       F.when(wrap, F.lit("</p>")).otherwise(F.lit("")))
    start = F.struct(
        F.col("pre").alias("at"), F.lit(0).alias("kind"), F.lit(0).alias("rev"),
        F.when(is_text(), escaped).otherwise(opening).alias("html"),
        F.when(is_text(), F.col("text")).otherwise(space).alias("plain"),
    )
    end = F.struct(
        F.col("last").alias("at"), F.lit(1).alias("kind"), (-F.col("pre")).alias("rev"),
        F.concat(F.lit("</"), node_tag(), F.lit(">")).alias("html"), space.alias("plain"),
    )
    pieces = F.when(is_text() | node_tag().isin(*VOID_TAGS), F.array(start)).otherwise(F.array(start, end))
    keys = keep or ["page_id"]
    rows = nodes.select(*keys, F.explode(pieces).alias("piece"))
    done = rows.groupBy(*keys).agg(F.array_sort(F.collect_list("piece")).alias("_p"))
    return done.select(
        *keys,
        F.array_join(F.transform("_p", lambda p: p["html"]), "").alias("html"),
        F.trim(F.regexp_replace(F.array_join(F.transform("_p", lambda p: p["plain"]), ""), r"[\s\u00a0]+", " "))
        .alias("plain"),
    )
