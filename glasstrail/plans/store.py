"""A stored, pruned and incremental search library.

Four tables, each split into versions, and the three that a search looks into also into ``BUCKETS`` parts by hash:

* ``docs``: captures with their facts;
* ``postings`` by token and ``keys`` by facet key, so a search reads the parts of its own tokens and keys only;
* ``vocabulary`` by first letter, so a prefix is expanded by reading one part.

Every change carries a sequence number. A version holds the captures that a batch of changes left, and in ``gone`` every
id the batch touched with its number. A row counts if no later change touched its capture: one anti-join of ``docs``
with the touched ids decides it, and postings and keys follow by joining ``docs`` on id and number. So batches may
arrive late or twice, and a batch's size is what it costs. ``compact`` writes the live rows as a new base.

A version counts from the moment its row in ``commits`` is written, the last thing it does; a batch that died half-way is
invisible and its repetition overwrites it.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.base import index_tokens
from ..functions.scoring import lexical_sql
from ..operators import fulltext as ft
from ..operators.ordered import with_rank
from ..session import checkpointed, stored
from ..sources.captures import NOW
from ..weights import RelevanceWeights
from . import search as plan

BUCKETS = 64
#: Largest relation, in rows, that a search may broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 50_000
#: Largest relation, in rows, that a search keeps on the driver: what a few queries ask for.
HELD_ROWS = 2_000
PARTS = {"postings": "token string, capture_id bigint, seq bigint, field int, pos int, version bigint, bucket int",
         "keys": "key string, capture_id bigint, seq bigint, version bigint, bucket int",
         "vocabulary": "token string, version bigint, bucket int", "gone": "capture_id bigint, seq bigint, version bigint"}


def bucket(column: Column | str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(BUCKETS)).cast("int")


def small(frame: DataFrame) -> DataFrame:
    """A stored relation, marked for broadcast if it is small enough."""
    return F.broadcast(frame) if frame.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else frame


def held(frame: DataFrame) -> DataFrame:
    """A relation that several steps read: as a local one if it has ``HELD_ROWS`` rows at most, else stored."""
    rows = frame.limit(HELD_ROWS + 1).collect()
    if len(rows) > HELD_ROWS:
        return small(checkpointed(frame))
    return F.broadcast(frame.sparkSession.createDataFrame(rows, frame.schema))


def buckets_of(frame: DataFrame) -> list[int]:
    """The parts that a held relation needs: at most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in frame.select("bucket").distinct().collect())


@dataclass(frozen=True)
class Store:
    """A library in a folder that driver and executors share."""
    spark: SparkSession
    folder: str

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def versions(self) -> list[int]:
        """Committed versions from the latest base on; one row per batch since the last compaction."""
        rows = sorted(self.spark.read.schema("base boolean, version bigint").parquet(self._path("commits")).select("version", "base").collect())
        start = max(i for i, r in enumerate(rows) if r["base"])
        return [r["version"] for r in rows[start:]]

    def read(self, name: str, versions: list[int] | None = None) -> DataFrame:
        reader = self.spark.read if name == "docs" else self.spark.read.schema(PARTS[name])
        return reader.parquet(self._path(name)).filter(F.col("version").isin(self.versions() if versions is None else versions))

    def _write(self, frame: DataFrame, name: str, version: int) -> None:
        target = f"{self._path(name)}/version={version}"
        if "bucket" in frame.columns:  # rebalance splits a part that a frequent token has made large
            frame.hint("rebalance", "bucket").sortWithinPartitions("bucket", frame.columns[0]).write.mode("overwrite").partitionBy("bucket").parquet(target)
        else:
            frame.write.mode("overwrite").parquet(target)

    def _write_version(self, docs: DataFrame, touched: DataFrame | None, version: int, base: bool) -> None:
        """``docs``: library documents with ``seq``; ``touched``: capture_id, seq."""
        self._write(docs, "docs", version)
        docs = self.spark.read.parquet(f"{self._path('docs')}/version={version}")
        tokens = ft.token_index(docs.select("capture_id", "filename", "ocr_text", "seq").withColumn("capture_id", F.struct("capture_id", "seq")))
        self._write(tokens.select("token", "capture_id.capture_id", "capture_id.seq", F.col("field").cast("int"), F.col("pos").cast("int"), bucket("token").alias("bucket")), "postings", version)
        keys = plan._document_keys(docs.withColumn("capture_id", F.struct("capture_id", "seq")))
        self._write(keys.select("key", "capture_id.capture_id", "capture_id.seq", bucket("key").alias("bucket")), "keys", version)
        written = self.spark.read.schema(PARTS["postings"]).parquet(f"{self._path('postings')}/version={version}")
        words = written.select("token").distinct().withColumn("bucket", bucket(F.left("token", F.lit(1))))
        if not base:
            words = words.join(self.read("vocabulary").select("token", "bucket"), ["token", "bucket"], "left_anti")
        self._write(words, "vocabulary", version)
        none = self.spark.createDataFrame([], "capture_id bigint, seq bigint")
        self._write(none if touched is None else touched, "gone", version)
        self.spark.range(1).select(F.lit(base).alias("base")).write.mode("overwrite").parquet(f"{self._path('commits')}/version={version}")

    def create(self, captures: DataFrame, version: int = 0) -> None:
        """The first base; every capture once."""
        self._write_version(plan.documents(captures).withColumn("seq", F.lit(0).cast("bigint")), None, version, True)

    def apply(self, changes: DataFrame, version: int) -> None:
        """One batch of changes: capture columns, ``seq`` (order of changes), ``deleted``.

        Of several changes of one capture the last counts. Extraction runs on what is left of the batch only.
        """
        newest = Window.partitionBy("capture_id").orderBy(F.desc("seq"))
        latest = changes.withColumn("_nth", F.row_number().over(newest)).filter("_nth = 1").drop("_nth")
        docs = plan.documents(latest.filter(~F.coalesce("deleted", F.lit(False))).drop("deleted"), keep=["seq"])
        self._write_version(docs, changes.groupBy("capture_id").agg(F.max("seq").alias("seq")), version, False)

    def live(self, versions: list[int] | None = None) -> DataFrame:
        """The documents that count."""
        versions = self.versions() if versions is None else versions
        docs = self.read("docs", versions)
        if len(versions) == 1:  # a base has nothing gone
            return docs
        gone = self.read("gone", versions).groupBy("capture_id").agg(F.max("seq").alias("gone_seq"))
        return docs.join(gone, (docs.capture_id == gone.capture_id) & (docs.seq < gone.gone_seq), "left_anti")

    def compact(self, version: int) -> None:
        """The live rows as a new base, under a version above all others."""
        self._write_version(self.live().drop("version"), None, version, True)

    # -- search ------------------------------------------------------------------------------------------------------

    def needles(self, queries: DataFrame, versions: list[int], prefix: bool = True) -> DataFrame:
        """``(query_id, kind, unit, offset, token, bucket, need)``: what the postings are asked for, kinds ALL, ANY and PHRASE."""
        terms = plan.query_terms(queries)
        exact = terms.select("query_id", F.col("term").alias("unit"), F.col("term").alias("token"))
        if prefix:
            first = bucket(F.left("term", F.lit(1)))
            asked = held(terms.select("term", F.length("term").alias("n"), first.alias("bucket")).distinct())
            words = self.read("vocabulary", versions).filter(F.col("bucket").isin(buckets_of(asked))).select("token")
            lengths = asked.groupBy().agg(F.array_sort(F.collect_set("n")).alias("lengths"))  # of one batch's terms: a few numbers
            cut = words.crossJoin(F.broadcast(lengths)).select("token", F.explode(F.filter("lengths", lambda n: n <= F.length("token"))).alias("n"))
            grown = cut.withColumn("term", F.expr("left(token, n)")).join(asked.select("term"), "term").select("term", "token")
            alls = terms.join(grown, "term").select("query_id", F.col("term").alias("unit"), "token")
        else:
            alls = exact
        phrases = queries.select("query_id", F.explode(F.array_distinct(F.filter("phrases", lambda p: F.contains(p, F.lit(" "))))).alias("unit"))
        words = phrases.select("query_id", "unit", F.posexplode(index_tokens(F.col("unit"))).alias("offset", "token"))
        n_terms = terms.groupBy("query_id").agg(F.count(F.lit(1)).alias("need"))
        n_words = words.groupBy("query_id", "unit").agg(F.count(F.lit(1)).alias("need")).filter("need > 1")
        columns = ["query_id", "kind", "unit", "offset", "token", "need"]
        none, one = F.lit(None).cast("int"), F.lit(1).cast("bigint")
        parts = [alls.join(n_terms, "query_id").withColumns({"kind": F.lit("ALL"), "offset": none}), exact.withColumns({"kind": F.lit("ANY"), "offset": none, "need": one}),
                 words.join(n_words, ["query_id", "unit"]).withColumn("kind", F.lit("PHRASE"))]
        return parts[0].select(*columns).unionByName(parts[1].select(*columns)).unionByName(parts[2].select(*columns)).withColumn("bucket", bucket("token"))

    def postings(self, needles: DataFrame, versions: list[int]) -> DataFrame:
        """The postings in the parts of the needles' tokens."""
        return self.read("postings", versions).filter(F.col("bucket").isin(buckets_of(needles)))

    def candidates(self, queries: DataFrame, versions: list[int], prefix: bool = True) -> DataFrame:
        """``(query_id, capture_id, seq, all_terms, any_term, phrase)``: one join with the postings, one with the keys."""
        shape = queries.agg(F.max(F.size("terms") + F.size("phrases")).alias("text")).first()
        flags = []
        keyed = held(plan._query_keys(queries).distinct().withColumn("bucket", bucket("key")))
        parts = buckets_of(keyed)
        if parts:
            keys = self.read("keys", versions).filter(F.col("bucket").isin(parts)).drop("bucket")
            flags.append(keys.join(keyed.drop("bucket"), "key").select("query_id", "capture_id", "seq", *[F.lit(False).alias(c) for c in ("all_terms", "any_term", "phrase")]))
        if shape["text"]:
            needles = held(self.needles(queries, versions, prefix))
            met = self.postings(needles, versions).drop("bucket").join(needles.drop("bucket"), "token")
            start = F.when(F.col("kind") == "PHRASE", F.col("pos") - F.col("offset"))
            met = met.select("query_id", "capture_id", "seq", "kind", "unit", "need", F.when(start.isNotNull(), F.col("field")).alias("field"), start.alias("start"))
            dealt = met.repartition("query_id", "capture_id")  # both groupings below stay in these partitions
            units = dealt.groupBy("query_id", "capture_id", "seq", "kind", "unit", "need", "field", "start").agg(F.count(F.lit(1)).alias("n")).filter("kind <> 'PHRASE' OR n = need")
            found = units.groupBy("query_id", "capture_id", "seq").agg(
                F.coalesce(F.count_if(F.col("kind") == "ALL") == F.max(F.when(F.col("kind") == "ALL", F.col("need"))), F.lit(False)).alias("all_terms"),
                F.max(F.col("kind") == "ANY").alias("any_term"), F.max(F.col("kind") == "PHRASE").alias("phrase"))
            flags.append(found.filter("all_terms OR any_term OR phrase"))
        if not flags:
            return self.spark.createDataFrame([], "query_id bigint, capture_id bigint, seq bigint, all_terms boolean, any_term boolean, phrase boolean")
        if len(flags) == 1:
            return flags[0].groupBy("query_id", "capture_id", "seq").agg(*[F.max(c).alias(c) for c in ("all_terms", "any_term", "phrase")]) if parts else flags[0]
        return flags[0].unionByName(flags[1]).groupBy("query_id", "capture_id", "seq").agg(*[F.max(c).alias(c) for c in ("all_terms", "any_term", "phrase")])

    def search(self, queries: DataFrame, limit: int | None = None, prefix: bool = True, now: int = NOW, weights: RelevanceWeights = RelevanceWeights(),
               ranks: bool = True) -> DataFrame:
        """``(query_id, capture_id, seq, rung, score, reasons, date_added, rank)``: the rows of ``search.ladder``, ranked; without ``ranks`` all
        rows with neither reasons nor rank.

        Rung and score come from one join with the documents; only ids, numbers and reasons are stored. ``limit`` keeps
        the best of each query.
        """
        versions = self.versions()
        queries = held(queries)
        docs = self.live(versions)
        d = docs.select("capture_id", "seq", F.struct(*[c for c in docs.columns if c not in ("seq", "version")]).alias("d"))
        q = queries.select("query_id", F.struct(*queries.columns).alias("q"))
        c = self.candidates(queries, versions, prefix).select("query_id", "capture_id", "seq", F.struct("all_terms", "any_term", "phrase").alias("c"))
        if not ranks and limit is not None:
            raise ValueError("the best rows are found by rank")
        met = c.join(d, ["capture_id", "seq"]).join(q, "query_id").withColumn("rung", F.expr(plan.rung_sql())).filter("rung IS NOT NULL")
        values = lambda frame: frame.withColumn("s", F.expr(lexical_sql(now, weights, with_reasons=ranks))).select(
            "query_id", "capture_id", "seq", "rung", F.col("s.score").alias("score"), *([F.col("s.reasons").alias("reasons")] if ranks else []), F.col("d.date_added").alias("date_added"))
        scored = values(met)
        bare = queries.filter("size(terms) + size(phrases) + size(hosts) + size(phones) + size(codes) + size(types) = 0 AND start_s IS NULL AND size(colors) = 0 AND NOT long_only")
        browsing = not bare.isEmpty()
        if browsing or limit is None:  # else one plan finds the first rung and the best rows of it
            scored = stored(scored)
            best = held(scored.groupBy("query_id").agg(F.min("rung").alias("rung")))
            scored = scored.join(best, ["query_id", "rung"])
        if browsing:  # every capture answers a query without text and filters that found nothing by price
            asked = bare.join(best, "query_id", "left_anti").select("query_id", F.struct(*bare.columns).alias("q"))
            browsed = d.crossJoin(held(asked)).withColumn("rung", F.expr("CASE WHEN size(q.prices) > 0 THEN 2 ELSE 0 END"))
            scored = scored.unionByName(values(browsed))
        name = F.get(F.array(*[F.lit(r) for r in plan.RUNGS]), F.col("rung"))
        if limit is not None:
            w = Window.partitionBy("query_id").orderBy("rung", F.desc("score"), F.desc("date_added"), "capture_id")
            top = scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
            first = F.min("rung").over(Window.partitionBy("query_id"))
            return top.withColumn("first", first).filter("rung = first").drop("first").withColumn("rung", name)
        scored = scored.withColumn("rung", name)
        if not ranks:
            return scored
        order = {"_score": -F.col("score"), "_date": -F.col("date_added")}
        return with_rank(scored.withColumns(order), ["query_id"], [*order, "capture_id"]).drop(*order)

    def texts(self, results: DataFrame) -> DataFrame:
        """Results with file name and text, fetched for the ranked rows only."""
        return results.join(self.live().select("capture_id", "seq", "filename", "ocr_text"), ["capture_id", "seq"])


def index_stream(changes: DataFrame, store: Store, checkpoint: str) -> None:
    """Apply a stream of changes, one version per micro-batch. A batch run twice overwrites its own version."""
    (changes.writeStream.option("checkpointLocation", checkpoint)
     .foreachBatch(lambda batch, k: store.apply(batch, k + 1)).trigger(availableNow=True).start().awaitTermination())
