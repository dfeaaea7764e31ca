"""Tables that micro-batches update safely, several at once.

A store is a folder of tables. A batch writes new versions of the buckets it touches and leaves
the others alone; then one manifest names the current version of every bucket of every table.
Readers go by the last manifest, so a batch's changes to all tables appear together or not at
all, whatever step a crash comes at.

Each try of a batch claims a name of its own and writes under it, so that tries and writers never
meet in a file. The manifest of a batch can be put in place once only: of two writers the second
finds it there, and its work is void. A batch that was committed is not applied again.
Versions that neither of the last two manifests names are removed.

Long texts can lie apart from their rows (``TextTable``): they are stored once, and rewriting a
bucket moves none of them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from feedloom import schema as S

BUCKETS = 32
SEGMENTS = 32  # a table's texts are gathered when they lie in more
GATHERED = "-1"  # the segment of gathered texts; others bear their batch's number
STORED = "zstd"  # tables hold whole texts, which a batch rewrites with their buckets

Merge = Callable[[DataFrame, DataFrame], DataFrame]


def bucket_of(key: str | Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Folder:
    """A folder on the session's file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._rename = getattr(self._fs, "Options$Rename")
        self._array = spark.sparkContext._gateway.new_array
        self.root = path
        conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._fs.Path(path).getFileSystem(conf)
        self._context = self._fs.FileContext.getFileContext(self.fs.makeQualified(self._fs.Path(path)).toUri(), conf)

    def _path(self, name: str):
        return self.fs.makeQualified(self._fs.Path(f"{self.root}/{name}"))

    def has(self, name: str) -> bool:
        return self.fs.exists(self._path(name))

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.has(name) else []

    def remove(self, name: str) -> None:
        self.fs.delete(self._path(name), True)

    def create(self, name: str, text: str) -> bool:
        """A small file that appears whole, unless there is one of that name already."""
        final = self._path(name)
        draft = self._path(f"_draft/{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(text.encode()))
        out.close()
        self.fs.mkdirs(final.getParent())
        options = self._array(self._rename, 1)
        options[0] = self._rename.NONE  # never over an existing file
        try:
            self._context.rename(draft, final, options)
        except Py4JJavaError:
            self.fs.delete(draft, False)
            if self.fs.exists(final):
                return False
            raise
        return True

    def text(self, name: str) -> str:
        found = self.fs.open(self._path(name))
        try:
            return self._io.toString(found, "UTF-8")
        finally:
            found.close()


class Store:
    """Tables that are committed together."""

    def __init__(self, root: str) -> None:
        self.root = root

    def table(self, name: str, schema: str, key: str, buckets: int = BUCKETS) -> VersionedTable:
        return VersionedTable(f"{self.root}/{name}", schema, key, buckets, self, name)

    def text_table(self, name: str, schema: str, key: str, texts: list[str], buckets: int = BUCKETS) -> TextTable:
        return TextTable(f"{self.root}/{name}", schema, key, buckets, self, name, texts)

    def snapshot(self, name: str, schema: str) -> Snapshot:
        return Snapshot(f"{self.root}/{name}", schema, self, name)

    @staticmethod
    def batches(folder: Folder) -> list[int]:
        """Committed batches that are still on record, in order."""
        return sorted(int(n.removesuffix(".json")) for n in folder.names("_manifest") if n.endswith(".json"))

    def state(self, folder: Folder, before: int | None = None) -> dict[str, dict[str, str]]:
        """Current version by table and bucket: at most one entry a bucket."""
        known = [b for b in self.batches(folder) if before is None or b < before]
        return json.loads(folder.text(f"_manifest/{known[-1]}.json")) if known else {}

    def batch(self, spark: SparkSession, batch_id: int) -> Batch:
        return Batch(self, spark, batch_id)


class Batch:
    """One try of a batch. ``done`` says that the batch was committed before: nothing is to do.

    As a context manager it commits at the end of its block, unless an error leaves it.
    """

    def __init__(self, store: Store, spark: SparkSession, batch_id: int) -> None:
        self.store, self.spark, self.id = store, spark, batch_id
        self.folder = Folder(spark, store.root)
        self.done = batch_id in store.batches(self.folder)
        self.before = store.state(self.folder, batch_id)
        self.now = {t: dict(v) for t, v in self.before.items()}
        self.version = ""
        if not self.done:
            tries = 0
            while not self.folder.create(f"_claim/{batch_id}.{tries}", ""):
                tries += 1
            self.version = f"{batch_id}.{tries}" if tries else str(batch_id)

    def __enter__(self) -> Batch:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is None and not self.done:
            self.commit()

    def read(self, table: VersionedTable, buckets: set[int] | None = None) -> DataFrame:
        """Rows of the table as this batch sees it: its own changes included."""
        return table.files(self.spark, self.now.get(table.name, {}), buckets)

    def update(self, table: VersionedTable, rows: DataFrame, merge: Merge) -> None:
        """Rewrite the touched buckets as ``merge(current rows, rows)``: once a table and batch."""
        touched = table.touched(rows)
        if not touched:
            return
        merged = merge(self.read(table, touched), rows).withColumn("bucket", bucket_of(table.key, table.buckets))
        # Rebalancing gathers a bucket's rows into few files and still splits an oversized one.
        out = merged.hint("rebalance", F.col("bucket"))
        out.write.option("compression", STORED).partitionBy("bucket").parquet(f"{table.path}/version={self.version}")
        self.now[table.name] = self.now.get(table.name, {}) | {str(b): self.version for b in touched}

    def write(self, snapshot: Snapshot, df: DataFrame) -> None:
        """Replace a small result as a whole."""
        df.write.parquet(f"{snapshot.path}/version={self.version}")
        self.now[snapshot.name] = {"": self.version}

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """An intermediate result of this try, stored so that its many readers share it."""
        out = f"{self.store.root}/_work/{self.version}/{name}"
        df.write.option("compression", STORED).parquet(out)
        return self.spark.read.schema(df.schema).parquet(out)

    def commit(self) -> None:
        """Make all changes visible at once, or raise if another writer was first."""
        if not self.folder.create(f"_manifest/{self.id}.json", json.dumps(self.now)):
            raise RuntimeError(f"batch {self.id} was committed by another writer")
        self._clean()

    def _clean(self) -> None:
        """Remove what only older manifests name, what tries left, and staged results. The last
        but one manifest stays, for readers on their way."""
        kept = [self.now, self.before]
        for b in [b for b in self.store.batches(self.folder) if b < self.id][:-1]:
            old = json.loads(self.folder.text(f"_manifest/{b}.json"))
            for table, versions in old.items():
                for bucket, version in versions.items():
                    if all(version != m.get(table, {}).get(bucket) for m in kept):
                        self._remove(table, version, bucket)
            self.folder.remove(f"_manifest/{b}.json")
        named = {v for m in kept for versions in m.values() for v in versions.values()}
        for claim in self.folder.names("_claim"):
            batch, _, tries = claim.partition(".")
            version = claim if tries != "0" else batch
            if int(batch) < self.id or version == self.version:
                self.folder.remove(f"_work/{version}")
            if int(batch) < self.id - 1:
                if version not in named:
                    for table in self.now:
                        self._remove(table, version)
                self.folder.remove(f"_claim/{claim}")

    def _remove(self, table: str, version: str, bucket: str = "") -> None:
        place = f"{table}/version={version}" if table else f"version={version}"
        self.folder.remove(f"{place}/bucket={bucket}" if bucket else place)
        if bucket and not any(n.startswith("bucket=") for n in self.folder.names(place)):
            self.folder.remove(place)


class VersionedTable:
    """A table of a store, or the only one of its own."""

    def __init__(self, path: str, schema: str, key: str, buckets: int = BUCKETS, store: Store | None = None, name: str = "") -> None:
        self.path, self.schema, self.key, self.buckets = path, schema, key, buckets
        self.store, self.name = store or Store(path), name

    def files(self, spark: SparkSession, versions: dict[str, str], buckets: set[int] | None = None) -> DataFrame:
        folder = Folder(spark, self.path)
        parts = [f"version={v}/bucket={b}" for b, v in versions.items() if buckets is None or int(b) in buckets]
        paths = [f"{self.path}/{p}" for p in parts if folder.has(p)]  # an emptied bucket has no files
        if not paths:
            return S.conform(spark.range(0).limit(0), self.schema)  # the planner sees that it is empty
        return spark.read.schema(self.schema).parquet(*paths)

    def read(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        """Current rows, or those before a batch."""
        return self.files(spark, self.store.state(Folder(spark, self.store.root), before).get(self.name, {}), buckets)

    def touched(self, keys: DataFrame) -> set[int]:
        """Buckets of a batch's keys: as many numbers as there are buckets, at most."""
        return {r[0] for r in keys.select(bucket_of(self.key, self.buckets)).distinct().collect()}

    def update(self, rows: DataFrame, batch_id: int, merge: Merge) -> None:
        """A batch that changes this table alone."""
        with self.store.batch(rows.sparkSession, batch_id) as batch:
            if not batch.done:
                batch.update(self, rows, merge)


class TextTable(VersionedTable):
    """A table whose long texts lie apart from the other columns.

    A batch stores its rows once, as they come, in a segment of its own. The table's rows hold
    the segment and the place there in place of the texts, so buckets are rewritten, sorted and
    shuffled without them; only ``read`` puts them back. Texts that no row names any more stay
    until they are more than half, or there are many segments: then the others are gathered.
    """

    PLACE = ("_segment", "_place")

    def __init__(self, path: str, schema: str, key: str, buckets: int, store: Store, name: str, texts: list[str]) -> None:
        parts = [p.strip() for p in schema.split(",")]
        self.columns, self.texts = [p.split()[0] for p in parts], texts
        place = [f"{c} BIGINT" for c in self.PLACE]
        super().__init__(path, ", ".join([p for p in parts if p.split()[0] not in texts] + place), key, buckets, store, name)
        self.segments = store.table(f"{name}_texts", ", ".join([p for p in parts if p.split()[0] in texts] + place), key)

    def add(self, batch: Batch, rows: DataFrame) -> DataFrame:
        """Store a batch's rows with their texts. Gives them with their place instead."""
        placed = rows.withColumns({"_segment": F.lit(batch.id).cast("bigint"), "_place": F.monotonically_increasing_id()})
        out = self._write(batch, placed, str(batch.id))
        return batch.spark.read.schema(placed.drop(*self.texts).schema).parquet(out)

    def gather(self, batch: Batch, used: int) -> None:
        """Store texts in use anew, if they lie in too many segments or are less than half of all.
        ``used`` is the number of the table's rows. Comes before the batch's own changes."""
        known = batch.now.get(self.segments.name, {})
        if known and (len(known) > SEGMENTS or batch.read(self.segments).count() > 2 * used):
            kept = batch.read(self.segments).join(batch.read(self).select(*self.PLACE), list(self.PLACE), "left_semi")
            batch.now[self.segments.name] = {}
            self._write(batch, kept, GATHERED)

    def _write(self, batch: Batch, rows: DataFrame, segment: str) -> str:
        out = f"{self.segments.path}/version={batch.version}/bucket={segment}"
        rows.write.option("compression", STORED).parquet(out)
        batch.now[self.segments.name] = batch.now.get(self.segments.name, {}) | {segment: batch.version}
        return out

    def read(self, spark: SparkSession, before: int | None = None, buckets: set[int] | None = None) -> DataFrame:
        state = self.store.state(Folder(spark, self.store.root), before)
        texts = self.segments.files(spark, state.get(self.segments.name, {}))
        return self.files(spark, state.get(self.name, {}), buckets).join(texts, list(self.PLACE), "left").select(*self.columns)


class Snapshot:
    """A small result that every batch replaces as a whole, such as a display list."""

    def __init__(self, path: str, schema: str, store: Store, name: str) -> None:
        self.path, self.schema, self.store, self.name = path, schema, store, name

    def read(self, spark: SparkSession) -> DataFrame:
        version = self.store.state(Folder(spark, self.store.root)).get(self.name, {}).get("")
        return spark.read.schema(self.schema).parquet(f"{self.path}/version={version}") if version else spark.createDataFrame([], self.schema)


def run(stream: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, mode: str = "append"):
    """Start a stream of micro-batches: with ``every`` on a clock, else until input is used up."""
    writer = stream.writeStream.foreachBatch(step).outputMode(mode).option("checkpointLocation", checkpoint)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()
