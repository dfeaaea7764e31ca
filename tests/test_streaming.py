from datetime import datetime

from pyspark.sql import functions as F

from feedloom import schema as S
from feedloom.streaming import jobs


def actions(spark, *rows):
    return spark.createDataFrame([(a, datetime(2024, 1, 1, 0, m), m, k) for a, m, k in rows],
                                 "article_id string, ts timestamp, seq bigint, action string")


def test_user_actions_fold_and_repeat(spark, tmp_path):
    job = jobs.UserActions(str(tmp_path), buckets=2)
    first = actions(spark, ("a", 1, "toggle_read"), ("b", 2, "read"), ("b", 3, "toggle_save"))
    second = actions(spark, ("a", 4, "toggle_read"), ("b", 5, "toggle_read"), ("c", 6, "delete"))
    job.step(first, 0)
    job.step(second, 1)
    job.step(second, 1)  # a repeated batch changes nothing
    got = {r.article_id: (r.is_read, r.is_saved, r.deleted) for r in job.state.read(spark).collect()}
    assert got == {"a": (False, False, False), "b": (False, True, False), "c": (False, False, True)}


def test_retry_counter_resets(spark, tmp_path):
    job = jobs.RetryCounter(str(tmp_path), buckets=2)
    def batch(*rows):
        return spark.createDataFrame([(a, datetime(2024, 1, 1, 0, m), m, o) for a, m, o in rows],
                                     "article_id string, ts timestamp, seq bigint, outcome string")
    job.step(batch(("a", 1, "failed"), ("a", 2, "failed"), ("b", 1, "failed")), 0)
    job.step(batch(("a", 3, "ok"), ("a", 4, "failed"), ("b", 5, "failed")), 1)
    assert {r.article_id: r.retry_count for r in job.state.read(spark).collect()} == {"a": 1, "b": 2}


def test_live_library_follows_changes(spark, tmp_path):
    job = jobs.LiveLibrary(str(tmp_path), buckets=2)
    def rows(*data):
        d = spark.createDataFrame([(i, s, i, datetime(2024, 1, int(i)), st, r) for i, s, st, r in data],
                                  "id string, source_id string, title string, added_at timestamp, fetch_status string, is_read boolean")
        return S.conform(d, S.ARTICLE).fillna({"is_saved": False})
    job.step(rows(("1", "s", "cached", False), ("2", "s", "pending", False), ("3", "t", "cached", False)), 0)
    job.step(rows(("2", "s", "cached", True)), 1)
    got = {r.source_id: (r.article_count, r.unread_count) for r in job.summary.read(spark).collect()}
    assert got == {"s": (2, 1), "t": (1, 1)}
    assert [r.id for r in job.latest.read(spark).filter("source_id = 's'").orderBy("rn").collect()] == ["2", "1"]


def articles(spark, *data):
    d = spark.createDataFrame([(i, s, f"t{i}", f"https://x.example.com/{i}", datetime(2024, 1, int(i)), st, saved) for i, s, st, saved in data],
                              "id string, source_id string, title string, article_url string, added_at timestamp, fetch_status string, is_saved boolean")
    return S.conform(d, S.ARTICLE).fillna({"is_read": False})


def test_a_moved_article_leaves_its_source(spark, tmp_path):
    job = jobs.LiveLibrary(str(tmp_path), buckets=3)
    job.step(articles(spark, ("1", "s", "cached", False), ("2", "u", "cached", False)), 0)
    job.step(articles(spark, ("1", "t", "cached", False)), 1)
    job.step(articles(spark, ("1", "t", "cached", False)), 1)
    assert {(r.id, r.source_id) for r in job.article.read(spark).collect()} == {("1", "t"), ("2", "u")}
    assert {r.source_id: r.article_count for r in job.summary.read(spark).collect()} == {"t": 1, "u": 1}
    assert {(r.source_id, r.id) for r in job.latest.read(spark).collect()} == {("t", "1"), ("u", "2")}


def test_an_emptied_bucket_stays_empty_and_old_versions_go(spark, tmp_path):
    from feedloom.streaming.tables import VersionedTable

    table = VersionedTable(str(tmp_path / "t"), "k string, v int", "k", 1)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    table.update(rows, 0, lambda current, new: current.unionByName(new))
    table.update(rows.filter("k = 'a'"), 1, lambda current, new: current.limit(0))
    assert table.read(spark).count() == 0 and table.read(spark, 1).count() == 2
    for k in range(2, 5):
        table.update(rows, k, lambda current, new: new)
    assert sorted(p.name for p in (tmp_path / "t").glob("version=*")) == ["version=3", "version=4"]
    files = table.read(spark).inputFiles()
    assert files and all("version=4" in f for f in files)


def test_late_actions_and_failures_find_their_place(spark, tmp_path):
    job = jobs.UserActions(str(tmp_path / "a"), buckets=2)
    for k, m in enumerate([(1, "read"), (5, "toggle_read"), (3, "read"), (4, "toggle_read"), (2, "toggle_read")]):
        job.step(actions(spark, ("a", *m)), k)
    # In order: read 1, toggle 2, read 3, toggle 4, toggle 5.
    assert [r.is_read for r in job.state.read(spark).collect()] == [True]
    retry = jobs.RetryCounter(str(tmp_path / "r"), buckets=2)
    for k, (m, outcome) in enumerate([(5, "ok"), (3, "failed"), (6, "failed"), (7, "failed"), (4, "refetch")]):
        retry.step(spark.createDataFrame([("a", datetime(2024, 1, 1, 0, m), m, outcome)], "article_id string, ts timestamp, seq bigint, outcome string"), k)
    assert [r.retry_count for r in retry.state.read(spark).collect()] == [2]


def feed(spark, source, *links):
    items = "".join(f"<item><title>{t}</title><link>{u}</link><pubDate>Mon, {d:02d} Jan 2024 00:00:00 GMT</pubDate></item>" for t, u, d in links)
    xml = f"<?xml version='1.0'?><rss version='2.0'><channel><title>{source}</title>{items}</channel></rss>"
    return spark.createDataFrame([(source, f"https://{source}.example.com/feed", xml, datetime(2024, 2, 1))],
                                 "source_id string, feed_url string, xml string, fetched_at timestamp")


def test_an_address_is_known_in_every_source_and_saved_rows_come_back(spark, tmp_path):
    job = jobs.RefreshStream(str(tmp_path), limit=None, buckets=3)
    job.load(articles(spark, ("9", S.SAVED_PAGES_ID, "cached", True), ("8", S.SAVED_PAGES_ID, "cached", True)), 0)
    job.step(feed(spark, "s", ("One", "https://x.example.com/one", 1)), 1)
    job.step(feed(spark, "t", ("Uno", "https://x.example.com/one", 1), ("Back", "https://x.example.com/9", 2)), 2)
    job.step(feed(spark, "u", ("Back", "https://x.example.com/9", 2)), 3)
    got = {(r.article_url[-3:], r.source_id) for r in job.article.read(spark).collect()}
    assert got == {("one", "s"), ("m/9", "t"), ("m/8", S.SAVED_PAGES_ID)}


def test_pruning_after_a_refresh(spark, tmp_path):
    job = jobs.RefreshStream(str(tmp_path), limit=2, buckets=3)
    job.load(articles(spark, ("1", "s", "cached", False), ("2", "s", "cached", True), ("3", "s", "cached", False), ("4", "s", "partial", False),
                      ("5", "other", "cached", False)), 0)
    job.step(feed(spark, "s", *[(f"N{k}", f"https://x.example.com/n{k}", k) for k in range(1, 5)]), 1)
    got = {(r.article_url.rsplit("/")[-1], r.source_id) for r in job.article.read(spark).collect()}
    assert got == {("2", S.SAVED_PAGES_ID), ("3", "s"), ("4", "s"), ("5", "other"), ("n3", "s"), ("n4", "s")}
    known = {r.article_url.rsplit("/")[-1] for r in job.address.read(spark).collect()}
    assert known == {"2", "3", "4", "5", "n3", "n4"}


def with_bodies(rows, letters):
    """Bodies of random letters, which no compression shortens much."""
    return rows.withColumn("rss_content_html", F.expr(
        f"left(array_join(transform(sequence(1, {letters} div 64 + 1), k -> sha2(concat(id, '/', is_saved, '/', k), 256)), ''), {letters})"))


def test_a_batch_leaves_other_articles_bodies_alone(spark, tmp_path):
    job, letters = jobs.LiveLibrary(str(tmp_path), buckets=2), 100_000
    job.step(with_bodies(articles(spark, *[(str(k), "s", "cached", False) for k in range(1, 25)]), letters), 0)
    first = {p for p in tmp_path.rglob("*.parquet")}
    job.step(with_bodies(articles(spark, ("1", "s", "cached", True), ("2", "t", "cached", True)), letters), 1)
    written = sum(p.stat().st_size for p in tmp_path.rglob("*.parquet") if p not in first)
    assert written < 5 * letters  # of 24 bodies in the same buckets
    want = {(str(k), "t" if k == 2 else "s", k <= 2) for k in range(1, 25)}
    now = job.article.read(spark)
    assert now.columns == S.columns(S.ARTICLE)
    assert {(r.id, r.source_id, r.is_saved) for r in now.collect()} == want
    assert now.exceptAll(with_bodies(now, letters)).count() == 0


def test_replaced_bodies_go(spark, tmp_path, monkeypatch):
    from feedloom.streaming import tables

    monkeypatch.setattr(tables, "SEGMENTS", 4)
    job = jobs.LiveLibrary(str(tmp_path), buckets=1)
    seen = []
    for k in range(7):  # an article is replaced each time; later ones come in small batches of their own
        rows = articles(spark, ("1", "st"[k % 2], "cached", k % 2 == 1), ("2", "s", "cached", False)) if k < 4 else articles(
            spark, (str(k), "s", "cached", False))
        job.step(with_bodies(rows, 100), k)
        held = job.article.segments.read(spark)
        seen.append((held.count(), held.select("_segment").distinct().count()))
        now = job.article.read(spark)
        assert now.exceptAll(with_bodies(now, 100)).count() == 0 and now.count() == max(2, k - 1)
    assert all(stored <= 2 * max(2, k - 1) + 2 for k, (stored, _) in enumerate(seen)), seen
    known = job.store.state(tables.Folder(spark, str(tmp_path)))["article_texts"]
    assert tables.GATHERED in known and len(known) <= 6
    named = [job.store.state(tables.Folder(spark, str(tmp_path)), b)["article_texts"] for b in (6, 7)]
    kept = {(f"version={v}", f"bucket={s}") for state in named for s, v in state.items()}
    assert {(p.parent.name, p.name) for p in (tmp_path / "article_texts").glob("version=*/bucket=*")} == kept


def random_changes(spark, rng, known, n):
    """Inserts, changes of any column that lists look at, and moves."""
    data = []
    for _ in range(n):
        i = rng.choice(sorted(known)) if known and rng.random() < 0.6 else f"a{len(known)}"
        row = (i, rng.choice(["s", "t", "u", S.SAVED_PAGES_ID]), f"t{i}", datetime(2024, 1, 1 + rng.randrange(28)),
               rng.choice(["cached", "partial", "pending", "failed"]), rng.random() < 0.5, rng.choice([None, "p"]),
               rng.choice([None, datetime(2024, 2, 1 + rng.randrange(28))]), rng.random() < 0.3)
        known[i] = row
        data.append((len(data), *row))
    d = spark.createDataFrame(data, "change_seq int, id string, source_id string, title string, added_at timestamp, fetch_status string, "
                                    "is_saved boolean, thumbnail_url string, saved_at timestamp, is_read boolean")
    return S.conform(d, S.ARTICLE + ", change_seq INT").selectExpr("*", "change_seq AS change_at")


def test_lists_equal_recomputation_after_any_changes(spark, tmp_path, monkeypatch):
    """Small lists, so that most batches run out of spare rows and fill some again."""
    import random

    from feedloom.operators import library as L

    rng, known = random.Random(11), {}
    monkeypatch.setattr(jobs, "SAVED_SIZE", 3)
    job = jobs.LiveLibrary(str(tmp_path), buckets=2)
    for kind in job.lists.kinds:
        object.__setattr__(kind, "spare", 1)
    for k in range(3):
        job.step(random_changes(spark, rng, known, 40), k)
        now = job.article.read(spark).cache()
        assert {r.id for r in now.collect()} == set(known)
        rows = lambda df, *c: sorted((tuple(r) for r in df.select(*c).collect()), key=str)
        assert rows(job.latest.read(spark), "source_id", "id", "rn") == rows(L.top_per_source(now), "source_id", "id", "rn")
        assert rows(job.balanced.read(spark), "id", "turn") == rows(L.balanced_latest(now), "id", "turn")
        assert rows(job.saved.read(spark), "id") == rows(L.saved_carousel(now, 3), "id")
        assert rows(job.summary.read(spark), "*") == rows(L.source_summary(now), "*")
        source = spark.createDataFrame([(s, s) for s in "stu"], "id string, title string")
        for size, n in L.DISPLAY_ROWS.items():
            got = [r.id for r in job.widgets.read(spark).filter(f"size = '{size}'").orderBy("rn").collect()]
            assert got == [r.id for r in L.display_list(now, source, size).collect()] and len(got) <= n, size
        now.unpersist()


def test_lists_read_touched_buckets_only(spark, tmp_path):
    job = jobs.LiveLibrary(str(tmp_path), buckets=16)
    job.step(articles(spark, *[(str(k), f"s{k}", "cached", False) for k in range(1, 25)]), 0)
    read = []
    whole = type(job.article).files
    job.article.files = lambda spark, versions, buckets=None: read.append(buckets) or whole(job.article, spark, versions, buckets)
    job.step(articles(spark, ("1", "s1", "cached", True), ("2", "s1", "cached", True)), 1)
    touched = job.article.touched(spark.createDataFrame([("s1",), ("s2",)], "source_id string"))
    assert read and all(b is not None and b <= touched for b in read)


def test_a_log_stays_bounded_and_any_order_gives_the_same(spark, tmp_path):
    import random

    rng = random.Random(3)
    seen = [("a", m % 60, "toggle_read") for m in range(57)] + [("b", 10, "read"), ("b", 40, "toggle_read"), ("c", 1, "toggle_save"), ("c", 2, "open")]
    want = {"a": (True, False, False), "b": (False, False, False), "c": (False, True, False)}
    for k in range(2):
        rng.shuffle(seen)
        job = jobs.UserActions(str(tmp_path / str(k)), buckets=2, tail=8)
        for j in range(0, len(seen), 16):
            job.step(actions(spark, *seen[j:j + 16]), j)
            assert max([0] + [r["count"] for r in job.log.read(spark).groupBy("article_id").count().collect()]) <= 8 + 4
        assert {r.article_id: (r.is_read, r.is_saved, r.deleted) for r in job.state.read(spark).collect()} == want
    # A mark among the last events ends what comes before it, the folded ones included.
    job.step(actions(spark, ("a", 54, "read")), 1000)
    assert {r.is_read for r in job.state.read(spark).filter("article_id = 'a'").collect()} == {True}


class Crash(Exception):
    pass


def test_a_crash_at_any_step_leaves_the_last_commit_and_a_retry_completes(spark, tmp_path, monkeypatch):
    from feedloom.streaming import tables

    def state(job):
        return ({(r.id, r.source_id) for r in job.article.read(spark).collect()},
                {(r.id, r.source_id) for r in job.address.read(spark).collect()})

    for step in range(3):  # before the articles, between them and the addresses, before the commit
        job = jobs.RefreshStream(str(tmp_path / str(step)), limit=None, buckets=2)
        job.load(articles(spark, ("1", "s", "cached", False)), 0)
        before, calls = state(job), []
        real = tables.Batch.update if step < 2 else tables.Batch.commit

        def fails(self, *args, real=real, step=step, calls=calls):
            calls.append(1)
            if len(calls) == (step + 1 if step < 2 else 1):
                raise Crash
            return real(self, *args)

        with monkeypatch.context() as m:
            m.setattr(tables.Batch, "update" if step < 2 else "commit", fails)
            try:
                job.step(feed(spark, "s", ("One", "https://x.example.com/one", 1)), 1)
            except Crash:
                pass
        assert state(job) == before
        job.step(feed(spark, "s", ("One", "https://x.example.com/one", 1)), 1)
        after = state(job)
        assert len(after[0]) == 2 and after[0] == after[1]
        job.step(feed(spark, "s", ("Two", "https://x.example.com/two", 2)), 1)  # committed: not applied again
        assert state(job) == after


def test_of_two_writers_one_commits(spark, tmp_path):
    import pytest

    from feedloom.streaming.tables import Store

    store = Store(str(tmp_path))
    table = store.table("t", "k string, v int", "k", 2)
    one, two = store.batch(spark, 0), store.batch(spark, 0)
    for batch, v in ((one, 1), (two, 2)):
        batch.update(table, spark.createDataFrame([("a", v), ("b", v)], "k string, v int"), lambda current, new: current.unionByName(new))
    two.commit()
    with pytest.raises(RuntimeError):
        one.commit()
    assert {r.v for r in table.read(spark).collect()} == {2}
    assert store.batch(spark, 0).done


def test_sources_turn_stale_without_input_and_after_a_restart(spark, tmp_path):
    import time
    from datetime import timedelta, timezone

    from feedloom.streaming.timers import StaleClock

    def ago(**span):
        return datetime.now(timezone.utc) - timedelta(**span)

    rows = "source_id string, ts timestamp"
    known = spark.createDataFrame([("never", None), (S.SAVED_PAGES_ID, None), ("fresh", ago(minutes=1)), ("soon", ago(minutes=30))],
                                  "id string, last_fetched_at timestamp")
    spark.createDataFrame([("soon", ago(minutes=59, seconds=40)), ("hour", ago(hours=2)), ("late", ago(hours=3)), ("late", ago(minutes=2))], rows
                          ).write.parquet(str(tmp_path / "in"))
    fetches = spark.readStream.schema(rows).parquet(str(tmp_path / "in"))
    job = StaleClock(str(tmp_path / "job"), known, "hour", buckets=2)
    job.settle(fetches)
    assert {(r.id, r.priority) for r in job.due(spark).collect()} == {("never", "deferred"), ("hour", "now")}
    # "soon" was fetched half an hour ago, says the table: its older fetch is late and changes
    # nothing. Half a minute is left for the source that the next start finds due.
    spark.createDataFrame([("hour", ago(seconds=1)), ("edge", ago(minutes=59, seconds=45))], rows).write.mode("append").parquet(str(tmp_path / "in"))
    again = StaleClock(str(tmp_path / "job"), known, "hour", buckets=2)
    again.settle(fetches)
    assert {r.id for r in again.due(spark).collect()} == {"never"} or {r.id for r in again.due(spark).collect()} == {"never", "edge"}
    time.sleep(16)  # no row arrives, and no stream runs, while the hour of "edge" passes
    third = StaleClock(str(tmp_path / "job"), known, "hour", buckets=2)
    third.settle(fetches)
    assert {(r.id, r.priority) for r in third.due(spark).collect()} == {("never", "deferred"), ("edge", "deferred")}
