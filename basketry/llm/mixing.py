"""Mixing sources to target weights by pivotal dependent rounding.

A source of S words with target T takes every document ``T/S`` times on
average: the integral part of that rate is a number of whole copies, the
fractional part a probability p of one more. The probabilities are rounded
together. Two documents a and b exchange mass, counted in words
(``p * size``), so that the words the source takes stay the same: either a
gains what b loses or the reverse, chosen at random so that each p keeps its
expectation, and far enough that one of the two becomes 0 or 1. That one is
settled, the other carries the rest on.

The exchanges form a reduction tree over Spark groups: units are dealt by
hash into blocks of about ``FAN`` units of one source, a block folds into one
residual unit, the residuals are dealt into blocks again, and so on until one
is left per source, which is rounded to the nearer integer. The taken words
of a source differ from its target by at most half of one document; blocks
are folded from the largest unit down, so that the last one tends to be
small. No group holds more than a few times ``FAN`` units, whatever the share
of a source.

Draws are hashes of seed and ids, and the order in a block is fixed, so
reruns agree.

Defined results: the size of a null text is 0; a document of size 0 takes no
words and one copy (it costs nothing); sources are ordered by code point with
null as the last; a source without words has target 0; rows equal in doc_id,
source and size are one unit whose rows share its copies; an empty table
gives an empty result. Only doc_id, source and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from basketry.llm.common import WORD, table

#: Units that one block of the tree folds, on average.
FAN = 96
MAX_COPIES = 2


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text)."""
    return docs.select("doc_id", "source", _size().alias("size"))


def _size() -> Column:
    n = F.regexp_count(F.col("text"), F.lit(WORD))
    return F.coalesce(n, F.lit(0)).cast("bigint")


def _position(src: DataFrame) -> DataFrame:
    """0-based position of every source in code-point order, null last, by
    range partitions and their offsets (no single-partition sort)."""
    order = F.col("source").asc_nulls_last()
    n = int(src.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = table(src.repartitionByRange(n, order)
                  .withColumn("part", F.spark_partition_id()), "mix-order")
    before = (dealt.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
              .withColumn("before", F.coalesce(F.sum("c").over(
                  Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .select("part", "before"))
    row = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return (dealt.withColumn("row", row).join(before, "part")
            .withColumn("position", F.col("row") + F.col("before")).drop("part", "row", "before"))


def targets(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5,
            most: int = MAX_COPIES) -> DataFrame:
    """source, source_size, n (rows), target.

    The sources, in code-point order, weigh ``weights`` over and over and
    share ``share`` times all words; a target stops at ``most`` times its
    source, and the excess is shared by weight among the rest until none is
    above. That fixed point is ``min(most * size, level * weight)`` for one
    common level, found in a few aggregate jobs over the sources.
    """
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count(F.lit(1)).alias("n"))
    src = _position(src)
    which = F.pmod(F.col("position"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          (which + 1).cast("int"))
    src = table(src.select("source", "source_size", "n", weight.alias("weight"),
                           (F.lit(most) * F.col("source_size")).alias("cap")), "mix-sources")
    words, weigh = src.agg(F.sum("source_size"), F.sum("weight")).first()
    if not words:
        return src.select("source", "source_size", "n", F.lit(0.0).alias("target"))
    total = share * words
    level, full = total / weigh, -1
    while True:
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        capped, rest, count = src.agg(
            F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))),
            F.count(F.when(over, 1))).first()
        if count == full or not rest:
            break
        level, full = (total - (capped or 0)) / rest, count
    return src.select("source", "source_size", "n", F.least(
        F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight")).alias("target"))


def _uniform(seed: int, *cols: Column) -> Column:
    """A number in [0, 1) drawn by hash."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _exchange(seed: int, level: int):
    """One step of the fold: the carried unit and the next one exchange mass;
    one settles, the other is carried on."""

    def step(acc: Column, b: Column) -> Column:
        a = acc["unit"]
        one = F.lit(1.0)
        a_room, a_has = (one - a["p"]) * a["mass"], a["p"] * a["mass"]
        b_room, b_has = (one - b["p"]) * b["mass"], b["p"] * b["mass"]
        gain, loss = F.least(a_room, b_has), F.least(a_has, b_room)
        up = _uniform(seed + level, a["key"], b["key"]) * (gain + loss) < loss
        a_settles = F.when(up, a_room <= b_has).otherwise(a_has <= b_room)
        settled_copy = F.when(up == a_settles, F.lit(1)).otherwise(F.lit(0))
        moved = F.when(up, gain).otherwise(loss)
        sign = F.when(up == a_settles, F.lit(-1.0)).otherwise(F.lit(1.0))
        settled = F.when(a_settles, a).otherwise(b)
        stays = F.when(a_settles, b).otherwise(a)
        p = F.least(F.greatest(stays["p"] + sign * moved / stays["mass"], F.lit(0.0)), one)
        return F.struct(
            F.struct(stays["key"].alias("key"), stays["doc_id"].alias("doc_id"),
                     stays["size"].alias("size"), stays["mass"].alias("mass"),
                     p.alias("p")).alias("unit"),
            F.concat(acc["done"], F.array(F.struct(
                settled["doc_id"].alias("doc_id"), settled["size"].alias("size"),
                settled_copy.alias("copy")))).alias("done"))

    return step


def _fold(units: DataFrame, seed: int, level: int) -> DataFrame:
    """source, blocks, unit (the residual), done (settled units) per block."""
    of_id = units.schema["doc_id"].dataType.simpleString()
    block = F.pmod(F.xxhash64(F.lit(seed * 31 + level), "key"), F.col("blocks"))
    packed = units.withColumn("block", block).groupBy("source", "blocks", "block").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("mass")).alias("order"), "key", "doc_id",
                                             "size", "mass", "p"))).alias("u"))
    packed = packed.withColumn("u", F.transform("u", lambda x: x.dropFields("order")))
    empty = F.array().cast(f"array<struct<doc_id:{of_id},size:bigint,copy:int>>")
    folded = F.aggregate(
        F.slice("u", 2, F.size("u")), F.struct(F.col("u")[0].alias("unit"), empty.alias("done")),
        _exchange(seed, level))
    return packed.select("source", "blocks", folded.alias("f")).select("source", "blocks", "f.*")


def mix(sized: DataFrame, target: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: one row per distinct
    (doc_id, source, size). ``sized`` as ``sizes`` gives, ``target`` as
    ``targets`` gives; both should be written tables."""
    unit = sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
    # the join meets a source's rows on one key: both sides are plain scans, so a
    # source too large for a broadcast is split by Spark's skew handling
    t = target.select(F.col("source").alias("t_source"), "source_size", "n", "target")
    unit = table(unit, "mix-units")
    joined = unit.join(t, unit["source"].eqNullSafe(t["t_source"])).drop("t_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    joined = (joined.withColumn("rate", rate).withColumn("whole", F.floor("rate").cast("int"))
              .withColumn("p", F.col("rate") - F.col("whole"))
              .withColumn("mass", (F.col("size") * F.col("rows")).cast("double")))
    joined = table(joined, "mix-rated")
    open_ = joined.where("size > 0 and p > 0").select(
        F.xxhash64(F.lit(seed), "doc_id", "size").alias("key"), "doc_id", "source", "size",
        "mass", "p", F.ceil(F.col("n") / F.lit(FAN)).cast("bigint").alias("blocks"))
    done, level = [], 0
    units, most = open_, joined.agg(F.max("n")).first()[0] or 0
    last = (most + FAN - 1) // FAN
    while True:
        folded = table(_fold(units, seed, level), f"mix-level{level}")
        done.append(folded.select("source", F.explode("done").alias("d"))
                    .select("d.doc_id", "source", "d.size", "d.copy"))
        ended = folded.where("blocks <= 1").select(
            "unit.doc_id", "source", "unit.size",
            F.when(F.col("unit.p") >= 0.5, 1).otherwise(0).alias("copy"))
        done.append(ended)
        if last <= 1:
            break
        units = folded.where("blocks > 1").select(
            "unit.key", "unit.doc_id", "source", "unit.size", "unit.mass", "unit.p",
            F.ceil(F.col("blocks") / F.lit(FAN)).cast("bigint").alias("blocks"))
        last, level = (last + FAN - 1) // FAN, level + 1
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    drawn = table(drawn, "mix-drawn")
    out = joined.alias("j").join(drawn.alias("d"), F.expr(
        "j.doc_id <=> d.doc_id and j.source <=> d.source and j.size = d.size"), "left")
    copies = F.when(F.col("j.size") == 0, 1).otherwise(
        F.col("j.whole") + F.coalesce(F.col("d.copy"), F.lit(0)))
    return out.select("j.doc_id", "j.source", "j.size", "j.source_size", "j.target",
                      copies.cast("bigint").alias("copies"))


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as its ``copies`` say."""
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"),
                      F.col("doc_id").alias("d"), F.col("source").alias("s"),
                      _size().alias("n"))
    # as many rows as documents: hashed by partition at every size, never broadcast
    copies = mixed.where("copies > 0").select("doc_id", "source", "size", "copies").hint(
        "shuffle_hash")
    met = row.join(copies, row["d"].eqNullSafe(copies["doc_id"])
                   & row["s"].eqNullSafe(copies["source"]) & (row["n"] == copies["size"]))
    # copies is at most MAX_COPIES
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(
        "row.*")
