"""Bitmaps as tables of 64-bit words (word, bits), spread like any other table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = 64


def sizes(n_bits: int) -> tuple[int, int]:
    """(words, bytes) that hold n bits."""
    words = -(-n_bits // WORD)
    return words, words * WORD // 8


def _word(place: Column) -> Column:
    return F.floor(place / F.lit(WORD)).cast("long")


def _mask(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(WORD)).cast("int"))


def build(places: DataFrame, place: str) -> DataFrame:
    """The words with these places set; words without any are left out."""
    return places.groupBy(_word(F.col(place)).alias("word")).agg(F.bit_or(_mask(F.col(place))).alias("bits"))


def put(words: DataFrame, places: DataFrame, place: str) -> DataFrame:
    """words with these places set as well."""
    return words.unionByName(build(places, place)).groupBy("word").agg(F.bit_or("bits").alias("bits"))


def reset(words: DataFrame, places: DataFrame, place: str) -> DataFrame:
    """words with these places cleared."""
    gone = build(places, place).withColumnRenamed("bits", "_gone")
    left = words.join(gone, "word", "left").select("word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("_gone", F.lit(0).cast("long")))).alias("bits"))
    return left.where("bits <> 0")


def is_set(places: DataFrame, place: str, words: DataFrame) -> DataFrame:
    """places and is_set."""
    held = places.withColumn("_word", _word(F.col(place))).join(words.withColumnsRenamed({"word": "_word", "bits": "_bits"}), "_word", "left")
    return held.withColumn("is_set", F.coalesce(F.col("_bits").bitwiseAND(_mask(F.col(place))) != 0, F.lit(False))).drop("_word", "_bits")


def cardinality(words: DataFrame) -> DataFrame:
    """One row: n, the number of set bits."""
    return words.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0)).cast("long").alias("n"))
