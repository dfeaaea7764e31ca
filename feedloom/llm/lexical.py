"""Ranked lexical search by two trees: the best documents of every item of a query set.

Documents become sparse vectors of impacts over the items' terms; an item is a sparse vector of
weights, and a score is their inner product, in whole numbers. Both sides have a hierarchy:

* Items are halved again and again by their similarity to two of them, and cut into leaves.
* Documents are sorted by their heaviest terms in Spark; each portion of the sorted rows is put
  in order by halving too, and cut into leaves, nodes of leaves, and so on.

Every node holds the greatest value of each coordinate below it. For an item node and a document
node, the product of these maxima is a bound on all scores between them: where it is less than
the weakest k-th score of the node's items, the whole batch is ruled out. A first, greedy walk
down the tree of each portion gives every item scores that set its k-th from the start; the
second walk is exact.

A task holds the trees of one portion and the items. Items are taken in batches of bounded size.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from feedloom.llm.common import keep, ranked
from feedloom.operators.skew import top_k

BATCH_BYTES = 8 << 20  # of items' texts whose vocabulary a task holds
GROUP_BYTES = 1 << 18  # of items' texts in one tree
LEAF_ITEMS, LEAF_DOCS, FAN = 4, 8, 8
PORTION = 1 << 17  # coordinates of the documents of a tree
AT_ONCE = 8  # leaves that are scored before the bounds are looked at again
MOST_IMPACT = 1_000_000  # fixed by the impact's formula

# Bytes that are neither ASCII letters or digits nor part of other characters end a term; A-Z are lower-cased.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


# ---------------------------------------------------------------- trees

def halved(starts: np.ndarray, terms: np.ndarray, values: np.ndarray, leaf: int) -> np.ndarray:
    """An order of sparse rows in which similar rows stand together.

    A set is cut in two equal parts by how much more similar its rows are to one than to another
    of two rows that have little in common, until ``leaf`` rows are left. Similar is what has a
    great cosine.
    """
    sizes = np.diff(starts)
    row = np.repeat(np.arange(len(sizes)), sizes)
    units = values / np.sqrt(np.maximum(np.bincount(row, values.astype(float) ** 2, len(sizes)), 1))[row]
    width = int(terms.max(initial=-1)) + 1
    out: list[np.ndarray] = []
    todo = [np.arange(len(sizes))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        ends = np.cumsum(sizes[rows])
        at = np.repeat(starts[rows] - ends + sizes[rows], sizes[rows]) + np.arange(ends[-1])
        member, t, v = np.repeat(np.arange(len(rows)), sizes[rows]), terms[at], units[at]

        def like(i: int) -> np.ndarray:
            dense = np.zeros(width)
            dense[t[ends[i] - sizes[rows[i]]:ends[i]]] = v[ends[i] - sizes[rows[i]]:ends[i]]
            return np.bincount(member, dense[t] * v, len(rows))

        one = like(int(like(0).argmin()))
        by = np.argsort(one - like(int(one.argmin())), kind="stable")
        half = -(-len(rows) // (2 * leaf)) * leaf  # whole leaves
        todo += [np.sort(rows[by[half:]]), np.sort(rows[by[:half]])]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _csr(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, coordinates and values of rows given as (coordinates, values)."""
    starts = np.append(0, np.cumsum([len(t) for t, _ in rows])).astype(np.int64)
    flat = [np.concatenate(x).astype(np.int64) if rows else np.zeros(0, np.int64) for x in (zip(*rows) if rows else ((), ()))]
    return starts, flat[0], flat[1]


@dataclass
class Node:
    items: np.ndarray
    terms: np.ndarray
    most: np.ndarray  # the greatest weight of each of the terms
    children: list["Node"] = field(default_factory=list)


def item_tree(items: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> Node:
    """Tree over some of the items, ``rows`` being (terms, weights) of all."""
    starts, terms, weights = _csr([rows[i] for i in items])
    unique, back = np.unique(terms, return_inverse=True)
    order = halved(starts, back, weights + 1, LEAF_ITEMS)
    level = [[int(items[j]) for j in order[a:a + LEAF_ITEMS]] for a in range(0, len(order), LEAF_ITEMS)]

    def node(members: list[int], children: list[Node]) -> Node:
        t = np.concatenate([rows[i][0] for i in members])
        w = np.concatenate([rows[i][1] for i in members])
        by = np.lexsort((-w, t))
        first = np.unique(t[by], return_index=True)[1]
        return Node(np.array(members), t[by][first], w[by][first], children)

    nodes = [node(m, []) for m in level]
    while len(nodes) > 1:
        nodes = [node([i for c in nodes[a:a + 2] for i in c.items], nodes[a:a + 2]) for a in range(0, len(nodes), 2)]
    return nodes[0] if nodes else Node(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))


class DocTree:
    """The documents of a portion, in order, and maxima of their coordinates level by level."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], kind=np.float64, weight: np.ndarray | None = None):
        starts, terms, impacts = _csr(rows)
        order = halved(starts, np.unique(terms, return_inverse=True)[1], impacts * (1 if weight is None else weight[terms] + 1), LEAF_DOCS)
        self.order = order
        self.starts, terms, impacts = _csr([rows[i] for i in order])
        self.terms, self.columns = np.unique(terms, return_inverse=True)
        self.impacts, width = impacts.astype(kind), len(self.terms)
        leaf = np.repeat(np.arange(len(order)) // LEAF_DOCS, np.diff(self.starts))
        key = leaf * width + self.columns
        by = np.argsort(key, kind="stable")
        cells, first = np.unique(key[by], return_index=True)
        maxima = np.zeros((-(-len(order) // LEAF_DOCS), width), kind)
        if len(cells):
            maxima.ravel()[cells] = np.maximum.reduceat(self.impacts[by], first)
        self.levels = [maxima]
        while len(self.levels[-1]) > FAN:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), FAN), axis=0))

    def children(self, level: int, nodes: np.ndarray) -> np.ndarray:
        below = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
        return below[below < len(self.levels[level - 1])]

    def scores(self, leaves: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Documents of the leaves, and scores [item, document], by weights [item, column]."""
        docs = (leaves[:, None] * LEAF_DOCS + np.arange(LEAF_DOCS)).ravel()
        docs = docs[docs < len(self.order)]  # every document has a coordinate
        sizes = self.starts[docs + 1] - self.starts[docs]
        ends = np.cumsum(sizes)
        at = np.repeat(self.starts[docs] - ends + sizes, sizes) + np.arange(ends[-1])
        return docs, np.add.reduceat(weights[:, self.columns[at]] * self.impacts[at], ends - sizes, axis=1)


class Walk:
    """The best documents so far of each item, over the portions of a task."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], roots: list[Node], weight: np.ndarray, least: np.ndarray, k: int):
        self.rows, self.roots, self.weight, self.k = rows, roots, weight, k
        whole = max((int(r.most.sum()) for r in roots), default=0) * MOST_IMPACT
        self.kind = np.float64 if whole < 1 << 53 else np.int64
        self.least = least.copy()  # the weakest score of interest of each item
        self.best: list[list[tuple]] = [[] for _ in rows]  # (-score, id missing, id), in order
        self.column = np.full(len(weight), -1, np.int64)
        self.scored = self.pairs = 0

    def portion(self, ids: list, docs: list[tuple[np.ndarray, np.ndarray]], greedy: bool) -> None:
        self.tree = DocTree(docs, self.kind, self.weight)
        self.ids = [ids[i] for i in self.tree.order]
        self.column[self.tree.terms] = np.arange(len(self.tree.terms))
        self.pairs += len(ids) * len(self.rows)
        top = len(self.tree.levels) - 1
        for root in self.roots:
            if greedy:
                for leaf in _leaves(root):
                    self.dive(leaf, top)
            else:
                self.visit(root, top, np.arange(len(self.tree.levels[top])))
        self.column[self.tree.terms] = -1

    def bounds(self, node: Node, level: int, nodes: np.ndarray) -> np.ndarray:
        column = self.column[node.terms]
        here = column >= 0
        return self.tree.levels[level][np.ix_(nodes, column[here])] @ node.most[here].astype(self.kind)

    def dive(self, node: Node, level: int) -> None:
        nodes = np.arange(len(self.tree.levels[level]))
        while True:
            bound = self.bounds(node, level, nodes)
            if not bound.max(initial=0):
                return
            nodes = nodes[[bound.argmax()]]
            if not level:
                return self.score(node, nodes)
            nodes, level = self.tree.children(level, nodes), level - 1

    def visit(self, node: Node, level: int, nodes: np.ndarray) -> None:
        bound = self.bounds(node, level, nodes)
        nodes = nodes[bound >= self.least[node.items].min(initial=np.iinfo(np.int64).max)]
        if not len(nodes):
            return
        if level:
            nodes, level = self.tree.children(level, nodes), level - 1
            for child in node.children or [node]:
                self.visit(child, level, nodes)
        elif node.children:
            for child in node.children:
                self.visit(child, 0, nodes)
        else:
            self.score(node, nodes)

    def score(self, node: Node, leaves: np.ndarray) -> None:
        """Leaves of documents against an item leaf, those of the highest bounds first."""
        weights = np.zeros((len(node.items), len(self.tree.terms)), self.kind)
        for j, i in enumerate(node.items):
            column = self.column[self.rows[i][0]]
            weights[j, column[column >= 0]] = self.rows[i][1][column >= 0]
        used = np.flatnonzero(weights.any(axis=0))
        bound = weights[:, used] @ self.tree.levels[0][np.ix_(leaves, used)].T  # of each item alone
        by = np.argsort(-bound.max(axis=0, initial=0), kind="stable")
        leaves, bound = leaves[by], bound[:, by]
        for a in range(0, len(leaves), AT_ONCE):
            open_ = (bound[:, a:a + AT_ONCE] >= self.least[node.items][:, None]).any(axis=0)
            if open_.any():
                docs, scores = self.tree.scores(leaves[a:a + AT_ONCE][open_], weights)
                self.scored += scores.size
                for j, d in zip(*np.nonzero(scores >= self.least[node.items][:, None])):
                    self.take(int(node.items[j]), int(scores[j, d]), self.ids[docs[d]])

    def take(self, item: int, score: int, doc) -> None:
        best = self.best[item]
        best.append((-score, doc is None, 0 if doc is None else doc))
        if len(best) >= 8 * self.k or len(best) == self.k:
            self.settle(item)

    def settle(self, item: int) -> None:
        best = sorted(self.best[item])[:self.k]
        self.best[item] = best
        if len(best) == self.k:
            self.least[item] = max(self.least[item], -best[-1][0])

    def found(self) -> Iterator[tuple[int, object, int]]:
        for item, best in enumerate(self.best):
            self.settle(item)
            for score, missing, doc in self.best[item]:
                yield item, None if missing else doc, -score


def _leaves(node: Node) -> Iterator[Node]:
    if not node.children:
        yield node
    for child in node.children:
        yield from _leaves(child)


# ---------------------------------------------------------------- Spark

def _batches(items: DataFrame) -> list[DataFrame]:
    """The items (id, text) in parts of at most ``BATCH_BYTES``, or of one item."""
    sized = keep(items.withColumn("size", F.octet_length("text")))
    total = sized.agg(F.sum("size")).first()[0] or 0
    if total <= BATCH_BYTES:
        return [sized.select("id", "text")]
    # Texts of about one length share a batch: its bound follows from their number.
    kinds = sized.withColumn("kind", F.length(F.bin("size")))
    placed = keep(ranked(keep(kinds), [F.col("kind"), F.col("id"), F.xxhash64("text")], "at"))
    out, first = [], 0
    for r in placed.groupBy("kind").count().orderBy("kind").collect():  # one row a power of two
        each = max(1, BATCH_BYTES >> r["kind"])
        out += [placed.filter((F.col("at") >= first + a) & (F.col("at") < first + min(a + each, r["count"]))).select("id", "text")
                for a in range(0, r["count"], each)]
        first += r["count"]
    return out


def _counted(docs: DataFrame, vocabulary: dict[bytes, int], kind: str) -> DataFrame:
    """Rows (id, n, terms, counts): all terms' number, and those of the vocabulary."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        number = vocabulary.get
        for batch in batches:
            n, terms, counts = [], [], []
            for text in batch.column(1).to_pylist():
                words = terms_of(text or b"")
                held = Counter(map(number, words))
                held.pop(None, None)
                n.append(len(words))
                terms.append(list(held))
                counts.append(list(held.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["id", "n", "terms", "counts"])

    return docs.mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<long>")


def _rows_of(batch, terms: int, values: int) -> list[tuple[np.ndarray, np.ndarray]]:
    t, v = batch.column(terms), batch.column(values)
    starts = np.append(0, np.cumsum(t.value_lengths().to_numpy(zero_copy_only=False)))
    t, v = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in (t, v))
    return [(t[a:b], v[a:b]) for a, b in zip(starts[:-1], starts[1:])]


def _weighed(counted: DataFrame, weight: np.ndarray, n_docs: int, n_terms: int, kind: str) -> DataFrame:
    """Rows (id, terms, impacts, heavy): documents with a term of an item; the three terms that
    can add most to a score, heaviest first."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            impacts, heavy = [], []
            for (terms, tf), n in zip(_rows_of(batch, 2, 3), batch.column(1).to_pylist()):
                m = 25 + 75 * n * n_docs // n_terms
                impact = 1_000_000_000 * tf // (1000 * tf + 8 * m)
                impacts.append(impact)
                by = np.lexsort((terms, -weight[terms] * impact))[:3]
                heavy.append(terms[by].tolist() + [-1] * (3 - len(by)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(impacts, pa.list_(pa.int64())), pa.array(heavy, pa.list_(pa.int32()))],
                names=["id", "terms", "impacts", "heavy"])

    return counted.filter(F.size("terms") > 0).mapInArrow(run, f"id {kind}, terms array<int>, impacts array<long>, heavy array<int>")


def _walked(docs: DataFrame, rows: list, groups: list[np.ndarray], weight: np.ndarray, least: np.ndarray, k: int, greedy: bool, kind: str, portion: int) -> DataFrame:
    """Rows (item, id, score): the best documents that each task has found for each item."""
    def run(batches) -> Iterator:
        import pyarrow as pa

        walk = Walk(rows, [item_tree(g, rows) for g in groups], weight, least, k)
        of = None
        for batch in batches:
            of = batch.schema.field(0).type
            ids, docs_ = batch.column(0).to_pylist(), _rows_of(batch, 1, 2)
            a = size = 0
            for b, (t, _) in enumerate(docs_):
                size += len(t)
                if size >= portion or b + 1 == len(docs_):
                    walk.portion(ids[a:b + 1], docs_[a:b + 1], greedy)
                    a, size = b + 1, 0
        found = list(walk.found())
        for a in range(0, len(found), 10_000):
            item, doc, score = zip(*found[a:a + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, of), pa.array(score, pa.int64())], names=["item", "id", "score"])

    return docs.select("id", "terms", "impacts").mapInArrow(run, f"item int, id {kind}, score long")


def _search(docs: DataFrame, items: list, k: int, item_kind: str, doc_kind: str, portion: int) -> DataFrame | None:
    """The best documents of a batch of items, given as rows (id, text)."""
    told = [Counter(terms_of((r["text"] or "").encode())) for r in items]
    vocabulary = {t: i for i, t in enumerate(sorted(set().union(*told)))}
    if not vocabulary:
        return None
    counted = keep(_counted(docs, vocabulary, doc_kind))
    totals = counted.agg(F.sum((F.col("n") > 0).cast("long")).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"] or 0, totals["terms"] or 0
    if not n_terms:
        return None
    weight = np.zeros(len(vocabulary), np.int64)
    for r in counted.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row a term of the batch
        weight[r["term"]] = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["count"] + 1)))
    rows = []
    for held in told:
        t = np.array(sorted(vocabulary[x] for x in held), np.int64)
        times = {vocabulary[x]: c for x, c in held.items()}
        rows.append((t, np.array([weight[x] * times[x] for x in t.tolist()], np.int64)))
    groups, size = [[]], 0
    for i, r in enumerate(items):
        if not told[i]:
            continue
        size += len(r["text"])
        if size > GROUP_BYTES and groups[-1]:
            groups.append([])
            size = len(r["text"])
        groups[-1].append(i)
    groups = [np.array(g, np.int64) for g in groups]
    heavy = [F.col("heavy")[j] for j in range(3)]
    placed = _weighed(counted, weight, n_docs, n_terms, doc_kind)
    placed = keep(placed.repartitionByRange(*heavy, F.xxhash64("id")).sortWithinPartitions(*heavy, F.xxhash64("id")))
    least = np.ones(len(rows), np.int64)  # scores above 0
    seeds = _walked(placed, rows, groups, weight, least, k, True, doc_kind, portion)
    for r in top_k(seeds, ["item"], [F.desc("score")], k).filter(F.col("rn") == k).select("item", "score").collect():  # one row an item
        least[r["item"]] = max(1, r["score"])
    found = top_k(_walked(placed, rows, groups, weight, least, k, False, doc_kind, portion), ["item"], [F.desc("score"), F.asc_nulls_last("id")], k, "rank")
    names = docs.sparkSession.createDataFrame([(i, r["id"]) for i, r in enumerate(items)], f"item int, item_id {item_kind}")
    return found.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", portion: int = PORTION) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): each item's ``k`` best documents with a score above 0.

    Terms are runs of ASCII letters and digits and of characters beyond ASCII, with only A-Z
    lower-cased; texts are read whole. A null or empty text has no terms: such a document is
    never found, such an item has no rows. Of several items of one id that with the least text
    counts; a null id is an id of its own. Every document row is a document, also if its id or
    text is repeated or its id is null; ties go to the smaller id, null last. Empty tables give
    no rows. Other columns are not read.
    """
    doc_kind, item_kind = docs.schema[doc_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    texts = docs.select(F.col(doc_col).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    asked = items.select(F.col(item_col).alias("id"), F.col(item_text_col).cast("string").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    parts = [_search(texts, batch.orderBy("id").collect(), k, item_kind, doc_kind, portion) for batch in _batches(asked)]  # a bounded batch each
    parts = [p for p in parts if p is not None]
    if parts:
        return reduce(DataFrame.union, parts)
    return docs.sparkSession.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {doc_kind}, score long")


SQL = r"""
WITH terms AS (
  SELECT doc_id, row_number() OVER () AS row, t FROM (
    SELECT doc_id, regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
    FROM documents WHERE text IS NOT NULL) WHERE len(t) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(len(t)) AS BIGINT) AS nt FROM terms
), wanted AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark WHERE text IS NOT NULL) GROUP BY item_id, term
), tf AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT row, doc_id, len(t) AS n, unnest(t) AS term FROM terms)
  WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(nd) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, totals GROUP BY term
), s AS (
  SELECT item_id, row, doc_id,
         CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM wanted JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, row, doc_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
