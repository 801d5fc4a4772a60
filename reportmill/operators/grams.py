"""Which names contain a text: an inverted index of grams, so that no name is compared with every text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grams(text: Column, n: int) -> Column:
    """The different substrings of n characters; none for a shorter text."""
    places = F.sequence(F.lit(1), F.length(text) - n + 1)
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


@dataclass(frozen=True)
class GramIndex:
    """first: gram, name, code of the first name that has the gram, for all grams of up to `size` characters, the empty
    one included. postings: gram, name, code of every name, for grams of `size`. spread: gram, n of its postings."""

    size: int
    first: DataFrame
    postings: DataFrame
    spread: DataFrame

    @classmethod
    def of(cls, symbols: DataFrame, size: int = 3) -> GramIndex:
        """symbols(name, code); of several codes of a name the first stands for it, names that are null are left out."""
        s = symbols.filter(F.col("name").isNotNull()).groupBy("name").agg(F.min("code").alias("code"))
        short = F.concat(F.array(F.lit("")), *[grams(F.col("name"), n) for n in range(1, size + 1)])
        first = s.select("name", "code", F.explode(short).alias("gram")).groupBy("gram").agg(F.min(F.struct(F.col("code").isNull(), "code", "name")).alias("s"))
        postings = s.select("name", "code", F.explode(grams(F.col("name"), size)).alias("gram"))
        return cls(size, first.select("gram", "s.name", "s.code"), postings, postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))

    def save(self, path: str) -> GramIndex:
        """Stored under path in place of what was there, and read from there."""
        for name in ("first", "postings", "spread"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/size={self.size}/{name}")
        return self.read(self.first.sparkSession, path, self.size)

    @classmethod
    def read(cls, spark: SparkSession, path: str, size: int = 3) -> GramIndex:
        return cls(size, *(spark.read.parquet(f"{path}/size={size}/{name}") for name in ("first", "postings", "spread")))

    def containing(self, asked: DataFrame) -> DataFrame:
        """text, name, code: the first name by code that contains the text, for the different texts of asked(text) that have one.

        Texts of up to `size` characters are looked up. Longer ones are compared with the names of one posting list
        alone: that of the text's gram in the fewest names. A text with a gram that no name has is in none.
        """
        texts = asked.select("text").filter(F.col("text").isNotNull()).distinct()
        short = texts.filter(F.length("text") <= self.size).join(self.first.withColumnRenamed("gram", "text"), "text")
        # one row a gram of a text; the rarest gram, if all are there
        long = texts.filter(F.length("text") > self.size).select("text", F.explode(grams(F.col("text"), self.size)).alias("gram"))
        known = long.join(self.spread, "gram", "left").groupBy("text").agg(F.count_if(F.col("n").isNull()).alias("absent"), F.min(F.struct("n", "gram")).alias("rarest"))
        probes = known.filter("absent = 0").select("text", "rarest.gram")
        found = probes.join(self.postings, "gram").filter(F.col("name").contains(F.col("text")))
        found = found.groupBy("text").agg(F.min(F.struct(F.col("code").isNull(), "code", "name")).alias("s")).select("text", "s.name", "s.code")
        return short.select("text", "name", "code").unionByName(found)
