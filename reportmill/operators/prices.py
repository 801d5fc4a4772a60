"""Names to tickers, and the recent prices of a ticker."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .grams import GramIndex


def resolve_tickers(asked: DataFrame, symbols: DataFrame, index: GramIndex | None = None) -> DataFrame:
    """name_asked, name, code for asked(name_asked): the symbol of that name, else the first that contains it, by code.

    Names without a symbol stay, with nulls; repeated ones count once. Equal names join on a hash; only names without an
    equal one are looked up in the index, which is made from the symbols unless there is a stored one.
    """
    index = index or GramIndex.of(symbols)
    names = asked.select("name_asked").distinct()
    s = symbols.select("name", "code").filter(F.col("name").isNotNull())
    equal = names.join(s, F.col("name_asked") == F.col("name")).groupBy("name_asked", "name").agg(F.min("code").alias("code"))
    rest = names.join(equal, "name_asked", "left_anti").select(F.col("name_asked").alias("text"))
    inside = index.containing(rest).withColumnRenamed("text", "name_asked")
    return names.join(equal.unionByName(inside.select("name_asked", "name", "code")), "name_asked", "left")


def recent_prices(prices: DataFrame, as_of: str, days: int = 14, rows: int = 5, ticker: str = "ticker", day: str = "trade_date") -> DataFrame:
    """Each ticker's last `rows` rows of the `days` days up to as_of."""
    window = prices.filter((F.col(day) >= F.date_sub(F.lit(as_of).cast("date"), days)) & (F.col(day) <= F.lit(as_of).cast("date")))
    last = Window.partitionBy(ticker).orderBy(*[F.col(c).desc() for c in [day, *[c for c in prices.columns if c not in (ticker, day)]]])
    return window.withColumn("_n", F.row_number().over(last)).filter(F.col("_n") <= rows).drop("_n").orderBy(ticker, day)


def price_answer(name: str, code: str | None, prices: DataFrame | None, most: int = 50) -> tuple[str, str]:
    """A status (unknown, empty, found) and a text for it: a markdown table of the prices of one ticker.

    The text has the first `most` rows and says how many more there are.
    """
    if code is None:
        return "unknown", f"{name}: 상장 종목 가운데 이 이름이 없습니다."
    rows = prices.limit(most + 1).collect()
    if not rows:
        return "empty", f"{name} ({code}): 이 기간에는 시세가 없습니다."
    lines = [f"**{name}** `{code}`", "", " | ".join(prices.columns), " | ".join("---" for _ in prices.columns)]
    lines += [" | ".join(str(v) for v in r) for r in rows[:most]]
    if len(rows) > most:
        lines.append(f"(+{prices.count() - most})")
    return "found", "\n".join(lines)
