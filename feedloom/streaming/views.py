"""First rows of many lists, kept by what changes.

A list holds the first rows of a group in a fixed order: at least ``k`` of them, if there are as
many. What it leaves out comes after its bound. A batch takes changed rows out of their lists
and puts those back that come before the bound, so most batches read nothing but the lists. Only
where rows left and fewer than ``k`` stay, while the bound says that there are more, the list is
filled again from the table's buckets of its group.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.operators.skew import top_k
from feedloom.streaming.tables import Batch, Store, VersionedTable, bucket_of

_LAST = (1 << 63) - 1
_POS = "struct<a:bigint,b:bigint,id:string>"


@dataclass(frozen=True)
class TopList:
    """A kind of list: which rows, grouped by what (a string column), in which order."""

    name: str
    group: Callable[[], Column]
    shows: Callable[[], Column]
    order: Callable[[], tuple[Column, Column]]  # descending timestamps, nulls last; then the id
    k: int
    spare: int = 15  # rows beyond k that a list keeps when it is filled or grows too long


def position(*order: Column) -> Column:
    """What orders a row in its list: the first comes first."""
    a, b = (F.coalesce(-F.unix_micros(c), F.lit(_LAST)) for c in order)
    return F.struct(a.alias("a"), b.alias("b"), F.col("id").alias("id")).cast(_POS)


class TopView:
    """Lists of several kinds over one table, in one table of a store.

    ``payload`` names columns of the base table that lists carry. ``base`` is bucketed by
    ``home``; a group's rows lie in one bucket of it.
    """

    def __init__(self, store: Store, name: str, base: VersionedTable, payload: str, kinds: list[TopList]) -> None:
        self.base, self.kinds, self.payload = base, kinds, [c.split()[0] for c in payload.split(",")]
        self.columns = ["list", "grp", "home", "id", "pos", "bound", "rn", *self.payload]
        self.table = store.table(name, f"list STRING, grp STRING, home INT, id STRING, pos {_POS}, bound {_POS}, rn INT, {payload}", "home", base.buckets)

    def _of(self, value: Callable[[TopList], object]) -> Column:
        """A value by the row's kind."""
        out = F.lit(None)
        for kind in self.kinds:
            out = F.when(F.col("list") == kind.name, value(kind)).otherwise(out)
        return out

    def _entries(self, rows: DataFrame, shown_only: bool) -> DataFrame:
        """A row's entries in the lists: one for each kind, or each that shows it."""
        entries = F.array(*[F.when(F.coalesce(kind.shows(), F.lit(False)) if shown_only else F.lit(True), F.struct(
            F.lit(kind.name).alias("list"), kind.group().alias("grp"), position(*kind.order()).alias("pos"))) for kind in self.kinds])
        return rows.withColumn("home", bucket_of(self.base.key, self.base.buckets)).withColumn(
            "_e", F.explode(F.array_compact(entries))).select("_e.*", "home", "id", *self.payload)

    def _touched(self, changes: DataFrame) -> DataFrame:
        """The lists that changes touch. Their groups come down to few rows before they are laid out by kind."""
        groups = changes.select(bucket_of(self.base.key, self.base.buckets).alias("home"), F.array(*[kind.group() for kind in self.kinds]).alias("_g")).distinct()
        lists = F.array(*[F.struct(F.lit(kind.name).alias("list"), F.col("_g")[i].alias("grp")) for i, kind in enumerate(self.kinds)])
        return groups.withColumn("_e", F.explode(lists)).select("_e.*", "home").distinct()

    def _cut(self, entries: DataFrame) -> DataFrame:
        """The first rows of each list, with the bound where rows were left out."""
        ranked = top_k(entries, ["list", "grp"], [F.col("pos")], max(kind.k + kind.spare for kind in self.kinds) + 1)
        most = self._of(lambda kind: F.lit(kind.k + kind.spare))
        whole = Window.partitionBy("list", "grp")
        last, more = F.max(F.when(F.col("rn") == most, F.col("pos"))).over(whole), F.max(F.col("rn")).over(whole) > most
        return ranked.withColumn("bound", F.when(more, last).otherwise(F.col("bound"))).filter(F.col("rn") <= most).select(*self.columns)

    def update(self, batch: Batch, changes: DataFrame) -> DataFrame:
        """Apply changed rows of the base table, which the batch has updated already; those
        marked ``_gone`` left their group. Gives the new lists of the touched groups."""
        touched = batch.stage(self._touched(changes), f"{self.table.name}-touched")
        homes = touched.select("home").distinct()
        known = batch.read(self.table, self.table.touched(homes)).join(touched, ["list", "grp", "home"], "left_semi")
        bounds = known.groupBy("list", "grp").agg(F.first("bound").alias("bound"))
        hit = self._entries(changes.join(known.select("id").distinct(), "id", "left_semi"), False)  # rows that lists hold
        stay = known.join(hit.select("list", "grp", "id"), ["list", "grp", "id"], "left_anti")
        fresh = self._entries(changes.filter(~F.col("_gone")), True).join(bounds, ["list", "grp"], "left").filter(
            F.col("bound").isNull() | (F.col("pos") <= F.col("bound")))
        lists = batch.stage(self._cut(stay.select(*fresh.columns).unionByName(fresh)), f"{self.table.name}-lists")
        # Too short, while the bound says that there are more.
        sizes = lists.groupBy("list", "grp").agg(F.count("*").alias("n"))
        short = touched.join(bounds.filter(F.col("bound").isNotNull()), ["list", "grp"]).join(sizes, ["list", "grp"], "left").filter(
            F.coalesce("n", F.lit(0)) < self._of(lambda kind: F.lit(kind.k))).select("list", "grp", "home")
        buckets = {r["home"] for r in short.select("home").distinct().collect()}  # as many as there are buckets, at most
        if buckets:
            whole = self._entries(batch.read(self.base, buckets), True).join(short, ["list", "grp", "home"], "left_semi")
            filled = self._cut(whole.withColumn("bound", F.lit(None).cast(_POS)))
            lists = batch.stage(lists.join(short, ["list", "grp"], "left_anti").select(*self.columns).unionByName(filled), f"{self.table.name}-filled")
        batch.update(self.table, touched.select("list", "grp", "home"), lambda current, groups: current.join(
            groups, ["list", "grp", "home"], "left_anti").select(*self.columns).unionByName(lists.select(*self.columns)))
        return lists

    def rows(self, spark, name: str, buckets: set[int] | None = None) -> DataFrame:
        return self.first(self.table.read(spark, None, buckets), name)

    def first(self, rows: DataFrame, name: str) -> DataFrame:
        """The first ``k`` rows of each list of a kind, with their rank."""
        k = next(kind.k for kind in self.kinds if kind.name == name)
        return rows.filter((F.col("list") == name) & (F.col("rn") <= k))
