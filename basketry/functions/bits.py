"""Sets of whole numbers as 64-bit words: a number lies in the word number
``n // 64`` at bit ``n % 64``. Words of one key merge by ``bit_or``, in any
order and any number of times, so a set of words is a state that grows by
merging; counts, intersections and runs follow from bit operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POWERS = (1, 2, 4, 8, 16, 32)


def word_of(n: Column) -> Column:
    """Number of the word that holds ``n`` (rounded down, also below zero)."""
    return F.shiftright(n.cast("bigint"), 6)


def bit_of(n: Column) -> Column:
    """The word with only the bit of ``n`` set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(n, F.lit(64)).cast("int"))


def words(df: DataFrame, keys: list[str], n: Column) -> DataFrame:
    """(keys, word, bits): the set of ``n`` of each key. Combined map-side, so a
    key's rows reach the shuffle as one row a word and task."""
    return df.where(n.isNotNull()).groupBy(*keys, word_of(n).alias("word")).agg(
        F.bit_or(bit_of(n)).alias("bits"))


def merge(sets: DataFrame, keys: list[str]) -> DataFrame:
    """The union of sets in parts: one row for each key and word."""
    return sets.groupBy(*keys, "word").agg(F.bit_or("bits").alias("bits"))


def sizes(sets: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Numbers in each key's set."""
    return sets.groupBy(*keys).agg(F.sum(F.bit_count("bits")).cast("bigint").alias(out))


def common(left: DataFrame, right: DataFrame, keys: list[str], out: str = "n") -> DataFrame:
    """Numbers that the sets of a key on both sides share (keys that share none
    are left out): words meet on (keys, word), never number by number."""
    other = right.select(*keys, "word", F.col("bits").alias("_o"))
    met = left.join(other, [*keys, "word"]).withColumn(
        "_b", F.col("bits").bitwiseAND(F.col("_o"))).where("_b != 0")
    return met.groupBy(*keys).agg(F.sum(F.bit_count("_b")).cast("bigint").alias(out))


# ---------------------------------------------------------------- runs of ones
def _shift(word: Column, n: Column) -> Column:
    """Unsigned shift to the right by 0 to 64."""
    return F.when(n >= 64, F.lit(0).cast("bigint")).otherwise(
        F.call_function("shiftrightunsigned", word, n))


def starts_of_runs(word: Column) -> Column:
    """Seven words: bit p of the i-th is set where 2**i ones begin at bit p."""
    return F.aggregate(
        F.array(*[F.lit(p) for p in POWERS]), F.array(word),
        lambda found, p: F.concat(found, F.array(F.element_at(found, -1).bitwiseAND(
            F.call_function("shiftrightunsigned", F.element_at(found, -1), p)))))


def _grow(runs: Column, holds) -> Column:
    """Length of a run put together from powers of two, the largest first:
    ``holds(word, length so far, power)`` tells whether it goes on."""
    return F.aggregate(
        F.reverse(F.sequence(F.lit(0), F.lit(len(POWERS)))), F.lit(0),
        lambda n, i: n + F.when(holds(F.get(runs, i), n, F.call_function("shiftleft", F.lit(1), i)),
                                F.call_function("shiftleft", F.lit(1), i)).otherwise(0))


def longest_run(runs: Column) -> Column:
    """Most ones in a row in a word with the given ``starts_of_runs``."""
    none = F.struct(F.lit(-1).cast("bigint").alias("at"), F.lit(0).alias("n"))

    def longer(s, i):
        at = s["at"].bitwiseAND(_shift(F.get(runs, i), s["n"]))
        return F.when(at != 0, F.struct(at.alias("at"), (s["n"] + F.call_function(
            "shiftleft", F.lit(1), i)).alias("n"))).otherwise(s)

    return F.aggregate(F.reverse(F.sequence(F.lit(0), F.lit(len(POWERS)))), none, longer,
                       lambda s: s["n"])


def first_run(runs: Column) -> Column:
    """Ones in a row from bit 0 on."""
    return _grow(runs, lambda word, n, p: _shift(word, n).bitwiseAND(F.lit(1).cast("bigint")) == 1)


def last_run(runs: Column) -> Column:
    """Ones in a row that end at bit 63."""
    return _grow(runs, lambda word, n, p: (n + p <= 64) & (_shift(word, F.greatest(
        64 - n - p, F.lit(0))).bitwiseAND(F.lit(1).cast("bigint")) == 1))


def longest_runs(sets: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Most consecutive numbers in each key's set. Every word becomes (run at
    its start, run at its end, longest run); a key's words, in order, are folded
    by joining the end of one with the start of the next."""
    runs = sets.select(*keys, "word", starts_of_runs(F.col("bits")).alias("_runs"))
    parts = runs.select(*keys, F.struct(
        "word", first_run(F.col("_runs")).alias("first"), last_run(F.col("_runs")).alias("last"),
        longest_run(F.col("_runs")).alias("best")).alias("_part"))
    start = F.struct(F.lit(None).cast("bigint").alias("word"), F.lit(0).alias("open"),
                     F.lit(0).alias("best"))

    def join(s, p):
        held = F.when(s["word"] + 1 == p["word"], s["open"]).otherwise(0)
        return F.struct(
            p["word"].alias("word"),
            F.when(p["first"] == 64, held + 64).otherwise(p["last"]).alias("open"),
            F.greatest(s["best"], p["best"], held + p["first"]).alias("best"))

    folded = F.aggregate(F.array_sort(F.collect_list("_part")), start, join, lambda s: s["best"])
    return parts.groupBy(*keys).agg(folded.cast("bigint").alias(out))
