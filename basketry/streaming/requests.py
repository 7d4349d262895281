"""Structured Streaming entry for batch inference (R15 per micro-batch).

Request files (one ``customer_id`` per row) land in a folder; each
micro-batch is answered with the same set-based job as the batch path (no
per-id loop) and written to ``<out>/batch_id=<n>`` (overwrite), so the answer
table is partitioned by batch and a replayed batch is idempotent. The
checkpoint location makes the stream restart where it stopped after a driver
or executor loss.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

Answer = Callable[[DataFrame], DataFrame]


def serve(spark: SparkSession, request_dir: str, answer: Answer, out_dir: str,
          checkpoint: str, schema: str = "customer_id bigint", fmt: str = "parquet",
          available_now: bool = False) -> StreamingQuery:
    """Start the request stream; ``answer(requests_df) -> DataFrame``."""
    stream = spark.readStream.schema(schema).format(fmt).load(request_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        # One folder per micro-batch, overwritten: a batch replayed after a
        # failure replaces its own answers instead of appending duplicates.
        (answer(batch.dropDuplicates(["customer_id"]))
         .write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/batch_id={batch_id}"))

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def popularity_answer(purchases: DataFrame, items: DataFrame, k: int = 5,
                      min_items: int = 5) -> Answer:
    """Answer with history and the popularity recommender (unseen items)."""
    from basketry.operators import interactions as I
    from basketry.operators import recommend as R
    from basketry.plans import serving
    from basketry.session import materialize

    # reduced once, when the stream starts; micro-batches read the written tables
    m = materialize(I.user_item_matrix(purchases))
    am = materialize(m.join(I.active_users(m, min_items), "customer_id", "left_semi"))
    ranked = R.ranked_popularity(am, m)

    def answer(requests: DataFrame) -> DataFrame:
        recs = R.with_names(R.recommend_unseen_by_rank(requests, m, ranked, k), items)
        return serving.batch(requests.select("customer_id"), am, recs, items)
    return answer
