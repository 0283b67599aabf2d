"""One object over the tables of a conversation memory: what is asked of it and what is done from time to time.

Turns come in batches or as a stream, in any order and possibly twice.  All that is kept lies under one
folder that all executors share; an engine opened there again goes on where the last one ended.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from palimpsest.operators import conversation, facts, graph, phrases, retrieval, tables, versions
from palimpsest.operators.keyed import KeyedTable
from palimpsest.operators.search_index import SearchIndex
from palimpsest.plans.steps import materialised
from palimpsest.streaming.rollups import Conversations

SCHEMAS = {
    "synced": ("conv_id", "conv_id long, synced_at long, turn_count long"),
    "extracted": ("conv_id", "conv_id long, extracted_at long"),
    "facts": ("id", "id string, conv_id long, content string, category string, confidence string, ts_ms long"),
    "settings": ("key", "key string, value string"),
    "log": ("id", "id string, timestamp long, conversations_flushed long, turns_flushed long, status string, error string"),
    "jobs": ("name", "name string, ran_at long, error string"),
}


class Job(NamedTuple):
    """What is done every ``every_ms``; ``run`` is given the engine and the time."""

    name: str
    every_ms: int
    run: Callable[[Engine, int], object]


class Engine:
    """The memory at ``path``.  Times are given, never read from the clock."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, jobs: tuple[Job, ...] = ()):
        self.spark, self.path, self.jobs = spark, path.rstrip("/"), jobs
        self._talk = Conversations(spark, f"{self.path}/talk", buckets)
        for name, (key, schema) in SCHEMAS.items():
            if not versions.latest(spark, f"{self.path}/{name}")[0]:
                KeyedTable.create(spark, f"{self.path}/{name}", schema, key, buckets)
        if not versions.latest(spark, f"{self.path}/index")[0]:
            SearchIndex.create(spark, f"{self.path}/index")

    def _table(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self.path}/{name}")

    @property
    def index(self) -> SearchIndex:
        return SearchIndex(self.spark, f"{self.path}/index")

    # -- turns

    def capture(self, turns: DataFrame, number: int) -> None:
        """Take in turns (id, conv_id, platform, turn, role, content, ts_ms), the ``number``-th batch from 0; again after a failure it changes nothing."""
        self._talk.arrive(turns, number)
        index = self.index
        index.add(materialised(index.missing(turns.select("id", "content"))), new=True)

    def following(self, turns: DataFrame, checkpoint: str, every: str | None = None) -> StreamingQuery:
        """Start a query that takes in a stream of turns and does what is due by their times.

        ``every`` is how long turns are waited for before they are taken together; without it, what is there is taken and the query ends.
        """

        def arrive(batch: DataFrame, number: int) -> None:
            batch = batch.persist()
            try:
                self.capture(batch, number)
                now = batch.agg(F.max("ts_ms")).first()[0]
            finally:
                batch.unpersist()
            if now is not None:
                self.run_due(now)

        out = turns.writeStream.foreachBatch(arrive).option("checkpointLocation", checkpoint)
        return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()

    def turns(self) -> DataFrame:
        return self._talk.turns()

    def conversations(self, limit: int | None = None, **options) -> DataFrame:
        """All roll-ups, or those that ``conversation.conversations`` lists."""
        rows = self._talk.rollup()
        return rows if limit is None else conversation.conversations(rows, limit, **options)

    def stats(self) -> DataFrame:
        return conversation.stats(self._talk.rollup(), self._table("synced").read().select("conv_id", "synced_at"))

    # -- sending

    def unsynced(self) -> DataFrame:
        """Roll-ups of conversations that were never sent, or got turns since, late ones included."""
        sent = self._table("synced").read().withColumnRenamed("turn_count", "sent_turns")
        rows = self._talk.rollup().join(sent, "conv_id", "left")
        due = F.col("synced_at").isNull() | (F.col("updated_at") > F.col("synced_at")) | (F.col("turn_count") > F.col("sent_turns"))
        return rows.where(due).drop("synced_at", "sent_turns")

    def flush(self, send: Callable[[DataFrame], object], now_ms: int) -> bool:
        """Send the turns of ``unsynced`` conversations and note it; what fails is logged and stays unsynced, so each is sent at least once."""
        due = materialised(self.unsynced().select("conv_id", "turn_count"))
        rows = materialised(self.turns().join(due.select("conv_id"), "conv_id", "left_semi"))
        error = None
        try:
            send(rows)
            self._table("synced").put(due.select("conv_id", F.lit(now_ms).cast("long").alias("synced_at"), "turn_count"), "synced_at", "turn_count")
        except Exception as e:
            error = str(e).partition("\n")[0][:500]
        self._table("log").put(conversation.sync_entry(rows, now_ms, error), "timestamp")
        return error is None

    def log(self, n: int = 20) -> DataFrame:
        return conversation.sync_log(self._table("log").read(), n)

    # -- facts, graph, dictionary

    def learn(self, extract: Callable[[DataFrame], DataFrame], now_ms: int, least_turns: int = 4, most: int = 3) -> None:
        """Take facts from the next ``most`` conversations that changed since facts were last taken from them; one with its text and conversation counts once."""
        due = materialised(conversation.to_extract(self._talk.rollup(), self._table("extracted").read(), least_turns, most).select("conv_id", "updated_at"))
        texts = conversation.extraction_text(self.turns().join(due.select("conv_id"), "conv_id", "left_semi"))
        found = materialised(facts.extracted(texts, extract))
        rows = found.select(F.sha2(F.concat_ws("\n", "conv_id", "content"), 256).alias("id"), "conv_id", "content", "category", "confidence", F.lit(now_ms).cast("long").alias("ts_ms"))
        self._table("facts").add(rows, "ts_ms", "category", "confidence")
        self._table("extracted").put(due.select("conv_id", F.col("updated_at").alias("extracted_at")), "extracted_at")

    def facts(self) -> DataFrame:
        return self._table("facts").read()

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Entities and relations of the facts."""
        known = self.facts()
        return graph.entities(known), graph.relations(known)

    def graph_stats(self) -> DataFrame:
        return graph.stats(*self.graph())

    def dictionary(self, newest: int = 500) -> DataFrame:
        """Symbols for the phrases of the ``newest`` conversations."""
        recent = conversation.conversations(self._talk.rollup(), newest).select("conv_id")
        return phrases.dictionary(phrases.candidates(phrases.phrase_counts(self.turns().join(recent, "conv_id", "left_semi"))))

    # -- asking

    def search(self, query: str, k: int = 16) -> DataFrame:
        return self.index.bm25(retrieval.query_terms(query), k)

    def retrieve(self, query: str) -> DataFrame:
        """What bears on a message, by the first layer that has any: turns, the graph, facts."""
        return retrieval.layered(query, self.turns(), lambda: graph.layer(*map(materialised, self.graph()), query), self.facts(), search=self.index.bm25)

    def setting(self, key: str, default: str) -> DataFrame:
        return tables.setting(self._table("settings").lookup(key), key, default)

    def save_settings(self, rows: DataFrame) -> None:
        self._table("settings").put(rows)

    # -- exports

    def export(self, path: str, exported_at: str, version: int = 1) -> None:
        tables.export_all(path, version, exported_at, conversations=self.turns(), facts=self.facts(), settings=self._table("settings").read(), syncLog=self._table("log").read())

    def import_(self, path: str, number: int) -> None:
        """Put an export's rows into the tables, its turns as batch ``number``; a fact or setting here gives way to that of its key there."""
        kinds = {name: SCHEMAS[at][1] for name, at in (("facts", "facts"), ("settings", "settings"), ("syncLog", "log"))}
        got = tables.import_all(self.spark, path, {"conversations": self.turns().schema.simpleString()[7:-1].replace(":", " "), **kinds})
        self.capture(got["conversations"], number)
        for name, rows in (("facts", got["facts"]), ("settings", got["settings"]), ("log", got["syncLog"])):
            self._table(name).put(rows)

    # -- what is done from time to time

    def due(self, now_ms: int) -> list[Job]:
        """Jobs that never ran or last ran their period ago, in their order; periods that were missed count once."""
        ran = {r["name"]: r["ran_at"] for r in self._table("jobs").read().collect()}  # a row for each job
        return [j for j in self.jobs if j.name not in ran or ran[j.name] + j.every_ms <= now_ms]

    def run_due(self, now_ms: int) -> list[str]:
        """Do what is due and note it; the names.  A job that fails is noted with its error, the others run, and it comes up again after its period."""
        done = []
        for job in self.due(now_ms):
            error = None
            try:
                job.run(self, now_ms)
            except Exception as e:
                error = str(e).partition("\n")[0][:500]
            row = self.spark.createDataFrame([(job.name, now_ms, error)], SCHEMAS["jobs"][1])
            self._table("jobs").put(row, "ran_at")
            done.append(job.name)
        return done

    def job_log(self) -> DataFrame:
        """name, ran_at, error of each job's last run."""
        return self._table("jobs").read()


def usual_jobs(send: Callable[[DataFrame], object], extract: Callable[[DataFrame], DataFrame], publish: Callable[[DataFrame], object]) -> tuple[Job, ...]:
    """Sending every 2 minutes, facts every 10, the dictionary every 30."""
    minute = 60_000
    return (
        Job("flush", 2 * minute, lambda e, now: e.flush(send, now)),
        Job("extract", 10 * minute, lambda e, now: e.learn(extract, now)),
        Job("dictionary", 30 * minute, lambda e, now: publish(e.dictionary())),
    )
