"""Incremental maintenance: a stream of page rows keeps state tables that equal the batch result after every micro-batch.

Each tracker turns the pages of a batch into a few narrow rows and adds them to its state by key: sums of counts, or the
row of the last page per URL. Every micro-batch writes a new version of each state table in the shared folder; a version
is whole or not there, so a stream that is stopped or loses executors goes on from its checkpoint and the last version.
Local issues are counted once per page row. Cross-page issues are read from the state: duplicates by value, links to pages
that are not 200 whichever of the two came first, hreflang targets that arrive later than their sources.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import issues
from ..plans.tables import keep, new_path, release, shared_folder

_CONTENT = "html_size_bytes > 0 AND status BETWEEN 200 AND 299 AND size(redirect_chain) = 0"


def _values(pages: DataFrame) -> DataFrame:
    kinds = F.create_map(*[x for n, c in (("title", "title"), ("meta_description", "meta_description"), ("h1", "h1"), ("h2", "get(h2_values, 0)"), ("content_hash", "content_hash")) for x in (F.lit(n), F.expr(c))])
    rows = pages.where(_CONTENT).select(F.explode(kinds).alias("kind", "value")).where("coalesce(value, '') <> ''")
    return rows.groupBy("kind", "value").agg(F.count("*").alias("n"))


def _pages(pages: DataFrame) -> DataFrame:
    row = F.struct("seq", "status", "indexability", "redirect_url", "redirect_chain", "html_size_bytes", "discovered_via_sitemap", "content_simhash", "content_hash")
    return pages.groupBy("url").agg(F.max_by(row, "seq").alias("page"))


def _edges(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("url").alias("source"), F.explode("outlinks").alias("o")).select("source", F.col("o.url").alias("target"), "o.nofollow")
    return rows.groupBy("source", "target", "nofollow").agg(F.count("*").alias("n"))


def _hreflang(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.col("url").alias("source"), F.explode("hreflang_links").alias("h")).select("source", "h.lang", "h.href")
    return rows.groupBy("source", "lang", "href").agg(F.count("*").alias("n"))


def _searches(pages: DataFrame) -> DataFrame:
    rows = pages.select(F.explode("custom_search_counts").alias("rule", "k"))
    return rows.groupBy("rule").agg(F.count_if(F.col("k") > 0).alias("contains"), F.count_if(F.col("k") == 0).alias("missing"))


def _extractions(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode(F.map_keys("extracted")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


def _prints(pages: DataFrame) -> DataFrame:
    rows = pages.where(f"{_CONTENT} AND content_simhash <> '' AND indexability = 'Indexable'")
    return rows.groupBy("content_simhash", "content_hash").agg(F.count("*").alias("n"))


def _local(pages: DataFrame) -> DataFrame:
    keys = tuple(r.key for r in issues.REGISTRY if r.scope == "page" and not r.cross)
    found = issues.exploded(issues.evaluated(pages, None, keys), "url")
    return found.groupBy("issue_key").agg(F.count("*").alias("n"))


def _progress(pages: DataFrame) -> DataFrame:
    bucket = F.when(F.col("status") > 0, F.concat(F.floor(F.col("status") / 100).cast("string"), F.lit("xx"))).otherwise("error")
    return pages.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


#: Tracker: its rows of some pages, and how rows of a key add up (None: the last page's row stays).
TRACKERS = {
    "duplicates": (_values, ("kind", "value"), ("n",)), "pages": (_pages, ("url",), None), "links": (_edges, ("source", "target", "nofollow"), ("n",)),
    "hreflang": (_hreflang, ("source", "lang", "href"), ("n",)), "searches": (_searches, ("rule",), ("contains", "missing")), "extractions": (_extractions, ("rule",), ("n",)),
    "fingerprints": (_prints, ("content_simhash", "content_hash"), ("n",)), "local_issues": (_local, ("issue_key",), ("n",)), "progress": (_progress, ("bucket",), ("n",)),
}


def apply_batch(state: DataFrame | None, rows: DataFrame, keys, sums) -> DataFrame:
    """The state after a batch's rows."""
    every = rows if state is None else state.unionByName(rows)
    added = [F.max_by("page", "page.seq").alias("page")] if sums is None else [F.sum(c).alias(c) for c in sums]
    return every.groupBy(*keys).agg(*added)


def of_batch(pages: DataFrame) -> dict[str, DataFrame]:
    """What the states are for all pages at once."""
    return {name: apply_batch(None, rows(pages), keys, sums) for name, (rows, keys, sums) in TRACKERS.items()}


class Tracked:
    """The states of a stream; use() as foreachBatch. A repeated batch (after a restart) is taken once.

    With a folder, each version is written there and marked when whole: a new object on the folder goes on from the last
    one, as the stream does from its checkpoint. Without one the tables are kept for this application.
    """

    def __init__(self, spark: SparkSession | None = None, folder: str | None = None, names=tuple(TRACKERS)):
        self.spark, self.folder, self.names, self.states, self.last = spark, folder, names, {}, -1
        done = self._versions() if folder else []
        if done:
            self.last = max(done)
            self.states = {n: spark.read.parquet(f"{folder}/{self.last}/{n}") for n in names}

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        at, files = self._files(f"{self.folder}/done")
        return [int(s.getPath().getName()) for s in files.listStatus(at)] if files.exists(at) else []

    def _kept(self, df: DataFrame, number: int, name: str) -> DataFrame:
        if not self.folder:
            return keep(df, f"state-{name}")
        path = f"{self.folder}/{number}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def use(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        batch = keep(batch, "stream-batch")
        after = {}
        for name in self.names:
            rows, keys, sums = TRACKERS[name]
            after[name] = self._kept(apply_batch(self.states.get(name), rows(batch), keys, sums), number, name)
        release(batch)
        if self.folder:
            at, files = self._files(f"{self.folder}/done/{number}")
            files.create(at, True).close()
            for old in ([f"{self.folder}/{self.last}", f"{self.folder}/done/{self.last}"] if self.last >= 0 else []):
                files.delete(self._files(old)[0], True)
        else:
            release(*self.states.values())
        self.states, self.last = after, number


class Throttled:
    """Runs what is offered at most once in so many seconds, the first at once; flush() runs the last one that had to wait.

    For what is dear to recompute while a stream runs (cross-page counts, the link score) and for progress messages: the
    last state is never lost, only states between are skipped.
    """

    def __init__(self, run, seconds: float, clock=time.monotonic):
        self.run, self.seconds, self.clock, self.at, self.waiting = run, seconds, clock, None, None

    def offer(self, *args) -> None:
        now = self.clock()
        if self.at is None or now - self.at >= self.seconds:
            self.at, self.waiting = now, None
            self.run(*args)
        else:
            self.waiting = args

    def flush(self) -> None:
        if self.waiting is not None:
            args, self.waiting = self.waiting, None
            self.run(*args)

    def cancel(self) -> None:
        self.waiting = None


class Progress(StreamingQueryListener):
    """Tells `emit` (rows so far, finished) of one query, throttled; the end is always told."""

    def __init__(self, emit, seconds: float = 0.1):
        self.rows, self.told = 0, Throttled(emit, seconds)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows += event.progress.numInputRows
        self.told.offer(self.rows, False)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.told.cancel()
        self.told.run(self.rows, True)


def track(pages: DataFrame, tracked: Tracked, checkpoint: str | None = None, **trigger):
    """A started query that keeps the states of a streaming frame of page rows; the default trigger runs to the end of what is there."""
    spark = pages.sparkSession
    where = checkpoint or new_path(spark, f"stream-{uuid.uuid4().hex[:8]}")
    return pages.writeStream.foreachBatch(tracked.use).option("checkpointLocation", where).trigger(**(trigger or {"availableNow": True})).start()


def duplicated(state: DataFrame) -> DataFrame:
    return state.where("n > 1").select("kind", "value", "n")


def cross_issues(states: dict[str, DataFrame], pages: DataFrame) -> DataFrame:
    """url, flags by the joins over the states of links, hreflang and pages, for pages that have arrived."""
    links = states["links"].select("source", "target")
    return issues.cross_flags(pages, links, states["hreflang"].select("source", "lang", "href"))


def duplicate_titles_stream(spark: SparkSession, folder: str, schema, checkpoint: str | None = None) -> DataFrame:
    """title, pages of the titles that several pages of a folder's files have, kept up file by file."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).where("title IS NOT NULL AND title <> ''")
    state: dict = {}

    def use(batch: DataFrame, number: int) -> None:
        if number <= state.get("last", -1):
            return
        after = keep(apply_batch(state.get("table"), batch.groupBy("title").agg(F.count("*").alias("pages")), ("title",), ("pages",)), "state-titles")
        if "table" in state:
            release(state["table"])
        state.update(table=after, last=number)

    where = checkpoint or f"{shared_folder(spark)}/siteloom/stream-{uuid.uuid4().hex[:12]}"
    rows.writeStream.foreachBatch(use).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    empty = spark.createDataFrame([], "title string, pages bigint")
    return state["table"].where("pages > 1") if state else empty


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts per type and window, tumbling or sliding; the same plan for a static and a streaming frame."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy((F.window("ts", width, slide) if slide else F.window("ts", width)).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream_counts(spark: SparkSession, path: str, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    """windowed_counts() of a stream over a folder's files, to its end. Complete mode: the last windows, which no later event closes, are in."""
    schema, out = spark.read.parquet(path).schema, new_path(spark, "windows")
    counts = windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")), width=width, slide=slide)

    def use(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")

    where = new_path(spark, "stream")
    counts.writeStream.outputMode("complete").foreachBatch(use).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()
    _, files = spark._jvm.org.apache.hadoop.fs.Path(out), spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    last = max(int(s.getPath().getName()) for s in files.listStatus(spark._jvm.org.apache.hadoop.fs.Path(out)))
    return spark.read.parquet(f"{out}/{last}")
