"""The user-item matrix and purchase days kept up to date.

A state folder holds changes and compacted tables:

* ``changes/batch=<id>``: what one batch of purchases adds, reduced to
  (customer_id, item_id, quantity) and (customer_id, word, bits) rows. A batch
  that is replayed replaces its own folder, so it counts once.
* ``whole/upto=<id>``: everything up to that batch. A compaction writes a new
  folder; a batch at or below the newest complete one is already in it and is
  not written again.

The state is the newest complete whole and the complete changes after it,
merged: quantities add up, bits are united. Popularity, activity and ranges
derive from the merged matrix by the same operators as from a full run, so the
state after any number of batches equals one run over all purchases. One writer
at a time (a stream has one); readers need no lock, as folders appear with their
success mark and are never changed in place by another batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from basketry.functions import bits as B
from basketry.operators import features
from basketry.operators import interactions as I
from basketry.sources import files

#: Parts of the state, their keys and how rows of one key merge.
PARTS = {"matrix": (["customer_id", "item_id"], lambda: F.sum("quantity").alias("quantity")),
         "days": (["customer_id", "word"], lambda: F.bit_or("bits").alias("bits"))}
EPOCH = "2023-01-01"


def _complete(spark: SparkSession, base: str, kind: str, label: str) -> list[int]:
    """Numbers of the complete folders of one kind, in order."""
    found = []
    for name in files.folders(spark, f"{base.rstrip('/')}/{kind}"):
        key, _, number = name.partition("=")
        root = f"{base.rstrip('/')}/{kind}/{name}"
        if key == label and all(files.exists(spark, f"{root}/{part}/_SUCCESS") for part in PARTS):
            found.append(int(number))
    return sorted(found)


def compacted(spark: SparkSession, base: str) -> int:
    """The last batch in the newest whole, or -1."""
    return max(_complete(spark, base, "whole", "upto"), default=-1)


def fold(purchases: DataFrame, base: str, batch_id: int) -> bool:
    """Add one batch of purchases; False when it is part of the whole already."""
    spark = purchases.sparkSession
    if batch_id <= compacted(spark, base):
        return False
    root = f"{base.rstrip('/')}/changes/batch={batch_id}"
    I.user_item_matrix(purchases).write.mode("overwrite").parquet(f"{root}/matrix")
    features.day_words(purchases, EPOCH).write.mode("overwrite").parquet(f"{root}/days")
    return True


def read(spark: SparkSession, base: str, part: str = "matrix") -> DataFrame:
    """A part of the state: ``matrix`` (customer_id, item_id, quantity) or ``days``
    (customer_id, word, bits)."""
    keys, merge = PARTS[part]
    upto = compacted(spark, base)
    paths = [f"{base.rstrip('/')}/whole/upto={upto}/{part}"] if upto >= 0 else []
    paths += [f"{base.rstrip('/')}/changes/batch={b}/{part}"
              for b in _complete(spark, base, "changes", "batch") if b > upto]
    if not paths:
        raise FileNotFoundError(f"no state under {base}")
    return spark.read.parquet(*paths).groupBy(*keys).agg(merge())


def compact(spark: SparkSession, base: str) -> int:
    """Write the whole state up to the last batch; returns that batch, or -1
    when there is nothing new. Older folders are left to the caller to remove."""
    new = [b for b in _complete(spark, base, "changes", "batch") if b > compacted(spark, base)]
    if not new:
        return -1
    root = f"{base.rstrip('/')}/whole/upto={new[-1]}"
    for part in PARTS:
        read(spark, base, part).write.mode("overwrite").parquet(f"{root}/{part}")
    return new[-1]


def streaks(spark: SparkSession, base: str) -> DataFrame:
    """A20 from the state: longest run of purchase days per customer."""
    return B.longest_runs(read(spark, base, "days"), ["customer_id"], "longest_purchase_streak")


def follow(spark: SparkSession, purchase_dir: str, base: str, checkpoint: str, schema,
           fmt: str = "parquet", compact_every: int = 16,
           available_now: bool = False) -> StreamingQuery:
    """Fold every new file of purchases into the state; every ``compact_every``
    batches the changes are merged into a new whole."""
    stream = spark.readStream.schema(schema).format(fmt).load(purchase_dir)

    def handle(batch: DataFrame, batch_id: int) -> None:
        fold(batch, base, batch_id)
        if (batch_id + 1) % compact_every == 0:
            compact(spark, base)

    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
