"""How far the sources of a language diverge, term by term.

Terms are counted by language and source, then each term becomes one row with an array of its counts by source. Arrays
of whole-number shares follow from it within the row, and for each pair of sources what the term adds to their
divergence; these contributions are summed, terms with equal counts together, before anything is shuffled.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, partitions, written

#: What is between terms: ASCII but letters. Splitting there is several times as fast as matching the terms.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Shares are whole numbers of this.
UNIT = 1_000_000_000


def lower_ascii(text: Column) -> Column:
    """Only A-Z in lower case; texts of ASCII alone take the short way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * count / total) for count <= total, three digits at a time: no product is beyond a long below 9e15."""
    out, rest = F.lit(0).cast("long"), count
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + whole(rest, total), rest % total
    return out + 1


def whole(a: Column, b: Column) -> Column:
    """a div b, for a >= 0 and b > 0."""
    return F.call_function("div", a, b)


def divergence(p: Column, q: Column) -> Column:
    return whole((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that have it)."""
    terms = F.split(lower_ascii("text"), BETWEEN)
    d = docs.select("lang", "source", terms.alias("terms"))
    # all terms of a document as list 0, the different ones as list 1
    each = d.select("lang", "source", F.posexplode(F.array(F.col("terms"), F.array_distinct("terms"))).alias("kind", "list"))
    each = each.select("lang", "source", "kind", F.explode("list").alias("term")).filter("term <> ''")
    return each.groupBy("lang", "source", "term").agg(F.count_if(F.col("kind") == 0).alias("n"), F.sum("kind").alias("docs"))


def source_divergence(docs: DataFrame, least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank for documents(text, lang, source), nulls read as ''.

    Each language keeps the terms of at least `least_docs` of its documents (rows). A group (lang, source) has p = 1 +
    floor(1e9 * (n + 1) / (N + V)) of each kept term, with its n occurrences there, N their sum and V the kept terms of
    the language; the language has q in the same way. Part `pair`: for each other source of the language, the sum of
    floor((p - q)**2 / q) with that source's p as q, over all kept terms; 0 without any. Part `term`: the terms that the
    group has with p > q, by floor((p - q)**2 / q), the first `top_terms`. Ranks start at 1 for each group and part, the
    highest value first, ties by the item's UTF-8 bytes.

    Groups without terms take part; an empty table gives no rows, and a language of one source no pairs. Repeated rows
    each count; other columns are ignored. A text's terms are an array of its own row; all sums are of longs, exact
    below 9e15 occurrences.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    d = docs.select(empty("text"), empty("lang"), empty("source"))
    counts = written(term_counts(d), "term-counts")

    # sources are numbered within their language; one row a group from here on
    groups = d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows"))
    groups = written(groups.withColumn("i", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1), "groups")
    n_sources = groups.groupBy("lang").agg(F.count(F.lit(1)).cast("int").alias("sources"))

    # one row a term with its counts by source; where a language has many sources, most are 0
    numbered = counts.join(groups.select("lang", "source", "i"), ["lang", "source"])
    wide = numbered.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang"), F.map_from_entries(F.collect_list(F.struct("i", "n"))).alias("by_source"))
    wide = wide.filter(F.col("docs") >= least_docs).join(n_sources, "lang")
    vector = F.transform(F.sequence(F.lit(0), F.col("sources") - 1), lambda i: F.coalesce(F.col("by_source")[i], F.lit(0).cast("long")))
    wide = written(wide.select("lang", "term", "n_lang", vector.alias("n")), "term-vectors")

    # totals by source, again as an array in the order of sources
    same = wide.groupBy("lang", "n", "n_lang").agg(F.count(F.lit(1)).alias("terms"))
    same = written(same, "equal-vectors")
    sums = same.select("lang", "terms", F.posexplode("n").alias("i", "c")).groupBy("lang", "i").agg(F.sum(F.col("c") * F.col("terms")).alias("total"))
    totals = sums.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "total"))), lambda x: x["total"]).alias("totals"))
    totals = totals.join(same.groupBy("lang").agg(F.sum("terms").alias("v"), F.sum(F.col("terms") * F.col("n_lang")).alias("total_lang")), "lang")

    shares = F.transform(F.arrays_zip("n", "totals"), lambda x: share(x["n"] + 1, x["totals"] + F.col("v")))
    per_vector = with_totals(same, totals).select("lang", "terms", shares.alias("p"))
    # floor((p - q)**2 / q) is floor(p * p / q) - 2 * p + q: a source's row emits the first for each source, which for itself
    # is p
    rows = per_vector.select("lang", "terms", "p", F.posexplode("p").alias("i", "own"))
    squares = rows.withColumn("own", F.col("own") * F.col("own"))
    pairs = squares.select("lang", "i", "terms", F.posexplode(F.transform("p", lambda q: whole(F.col("own"), q))).alias("j", "f"))
    pair_sums = written(pairs.groupBy("lang", "i", "j").agg(F.sum(F.col("f") * F.col("terms")).alias("f")), "pair-sums")
    alone = pair_sums.filter("i = j").select("lang", "i", F.col("f").alias("p"))
    sums = pair_sums.filter("i <> j").join(alone, ["lang", "i"]).join(alone.select("lang", F.col("i").alias("j"), F.col("p").alias("q")), ["lang", "j"])
    sums = sums.select("lang", "i", "j", (F.col("f") - 2 * F.col("p") + F.col("q")).alias("value"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("i").alias("j"))
    pair = groups.select("lang", "source", "i").join(other, "lang").filter("i <> j").join(sums, ["lang", "i", "j"], "left")
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))

    terms = with_totals(wide, totals).select("lang", "term", share(F.col("n_lang") + 1, F.col("total_lang") + F.col("v")).alias("q"), F.posexplode(F.arrays_zip(F.col("n"), shares.alias("p"))).alias("i", "x"))
    terms = terms.select("lang", "term", "i", "q", F.col("x.n").alias("n"), F.col("x.p").alias("p")).filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    term = terms.join(groups.select("lang", "source", "i"), ["lang", "i"])
    term = term.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))

    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda part: part.withColumn("rank", F.row_number().over(order))
    out = written(ranked(pair).unionByName(ranked(term).filter(F.col("rank") <= top_terms)), "divergences")
    forget(counts, groups, wide, same, pair_sums)
    return out


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """df with its language's totals. One language can have most terms, so rows are dealt out over all tasks, few as
    they may be: there is much to do for each. Totals go to each of the language's slices; where Spark knows them to be
    small it sends them everywhere instead."""
    n = partitions(df.sparkSession)
    dealt = df.withColumn("_s", F.pmod(F.xxhash64(*df.columns), F.lit(n)).cast("int")).repartition(n, *df.columns)
    return dealt.join(totals.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["lang", "_s"]).drop("_s")


UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
t AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
x AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0)::HUGEINT AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT x.lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY x.lang, source) + v) AS p FROM x JOIN v ON v.lang = x.lang),
l AS (SELECT x.lang, term, sum(n) AS n FROM x GROUP BY x.lang, term),
q AS (SELECT l.lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY l.lang) + v) AS q FROM l JOIN v ON v.lang = l.lang),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
      LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
      UNION ALL SELECT p.lang, source, 'term', p.term, ((p - q) * (p - q) // q)::BIGINT FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q)
SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM o QUALIFY part = 'pair' OR rank <= 200
"""
