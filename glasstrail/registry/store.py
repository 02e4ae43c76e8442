"""The stored library: pruned search, and an index kept up to date by a stream of changes."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..plans.store import Store, index_stream
from ..session import stored
from ..streaming.jobs import work_folder
from . import ranking  # noqa: F401  (its SQL pieces)
from .core import SHARED, Inputs, query, shared
from .fulltext import query_frame


_RUNG = "['EXACT', 'PRICE_APPROXIMATE', 'TEXT_ONLY', 'ANY_TERM', 'FILTERS_ONLY'][best + 1] AS rung"


def _searched(i: Inputs):
    from .filters import with_duplicates
    from .visual import visuals
    return with_duplicates(i).join(visuals(i).select("capture_id", "colors", "is_dark"), "capture_id", "left")


@query("search_stored", f"SELECT query_id, capture_id, {_RUNG}, score FROM scored")
def search_stored(i: Inputs):
    store = Store(i.spark, work_folder(i.spark, "library"))
    store.create(_searched(i))
    return store.search(query_frame(i), ranks=False).select("query_id", "capture_id", "rung", F.col("score").cast("bigint").alias("score"))


# The pieces of the search's SQL over the captures that the change log leaves: its deletions take every tenth.
shared("pairs_left", SHARED["pairs"] + " AND c.capture_id % 10 <> 7")
for _piece, _over in (("rungs", "pairs"), ("answers", "rungs"), ("scored", "answers")):
    shared(f"{_piece}_left", SHARED[_piece].replace(f"FROM {_over}", f"FROM {_over}_left"))


@query("index_incremental", f"SELECT query_id, capture_id, {_RUNG}, score FROM scored_left")
def index_incremental(i: Inputs):
    """A base of drafts, then a stream of three batches: second drafts, the texts as they are with late drafts among them, deletions."""
    captures = stored(_searched(i))  # read for the base and for each batch
    folder = work_folder(i.spark, "changes")

    def batch(k: int, frame, seq: int, deleted: bool = False) -> None:
        values = frame.withColumns({"seq": F.lit(seq).cast("bigint"), "deleted": F.lit(deleted)})
        values.write.mode("append").parquet(f"{folder}/log/{k}")

    def caught_up() -> None:
        """A job that starts again and finds the new files; its checkpoint remembers the old ones."""
        schema = i.spark.read.parquet(f"{folder}/log/0").schema
        index_stream(i.spark.readStream.schema(schema).parquet(f"{folder}/log/*"), store, f"{folder}/checkpoint")

    draft = lambda text: captures.withColumn("ocr_text", F.concat(F.lit(text), F.col("capture_id")))
    store = Store(i.spark, f"{folder}/library")
    store.create(draft("draft pixel 9a amazon.in ₹6,500 "))
    batch(0, draft("second draft headphones github.com ₹40 "), 1)
    caught_up()
    batch(1, captures, 3)
    batch(1, draft("late usb cable "), 2)
    caught_up()
    batch(2, captures.filter("capture_id % 10 = 7"), 4, True)
    caught_up()
    return store.search(query_frame(i), ranks=False).select("query_id", "capture_id", "rung", F.col("score").cast("bigint").alias("score"))
