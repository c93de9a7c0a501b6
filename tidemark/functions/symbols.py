"""Instrument names: normal forms, classes and universe filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Asset sets and name patterns of the universe filters.
MEME_PATTERNS = [
    "BABY", "SAFE", "MOON", "LUNC", "INU", "COIN", "TOKEN", "1000", "10000", "ELON", "DOGE", "SHIB", "PEPE",
    "FLOKI", "X", "V2", "OLD", "CUMROCKET", "PUSSY", "CUMMIES", "RIBBIT",
]
TIER1 = ["BTC", "ETH", "BNB", "XRP", "ADA", "SOL", "DOT", "LINK"]
STABLECOINS = ["USDC", "USDT", "FDUSD", "USDE", "TUSD", "BUSD", "DAI", "PYUSD", "GUSD", "USDM"]
COMMODITIES = ["CL", "NG", "XAU", "XAG", "WTI", "BRENT", "SPX", "NDX", "DJI", "GLD"]
MAJORS = ["BTC", "ETH", "BNB", "SOL"]
COMMODITY_QUOTES = ["USDT", "USDC", "BUSD", "FDUSD"]
BASE_QUOTES = ["USDT", "USDC", "USD", "FDUSD", "BUSD"]
MEME_QUOTES = ["USDT", "BUSD", "USDC", "FDUSD"]
MIN_QUOTE_VOLUME = 500_000


def exchange_symbol(symbol: Column) -> Column:
    """``BTC/USDT:USDT`` to ``BTCUSDT``."""
    return F.upper(F.regexp_replace(F.split_part(symbol, F.lit(":"), F.lit(1)), "[/-]", ""))


def base_asset(symbol: Column) -> Column:
    """Base of a pair; the first quote in the list that ends the name is cut."""
    name = F.upper(symbol)
    plain = F.split_part(name, F.lit(":"), F.lit(1))
    cut = plain
    for quote in reversed(BASE_QUOTES):
        cut = F.when(plain.endswith(quote), F.left(plain, F.length(plain) - len(quote))).otherwise(cut)
    return F.when(F.contains(name, F.lit("/")), F.split_part(name, F.lit("/"), F.lit(1))).otherwise(cut)


def is_major(symbol: Column) -> Column:
    return base_asset(symbol).isin(*MAJORS)


def is_stable_pair(symbol: Column) -> Column:
    """Both sides of the pair are stablecoins."""
    name = F.regexp_replace(F.upper(symbol), "[/:-]", "")
    coins = "|".join(STABLECOINS)
    return name.rlike(f"^({coins})({coins})$")


def is_commodity_pair(symbol: Column) -> Column:
    """The base, matched whole, is a commodity or index contract."""
    name = F.regexp_replace(F.split_part(F.upper(symbol), F.lit(":"), F.lit(1)), "[/-]", "")
    hit = F.lit(False)
    for quote in reversed(COMMODITY_QUOTES):
        base = F.left(name, F.length(name) - len(quote))
        hit = F.when(name.endswith(quote), base.isin(*COMMODITIES)).otherwise(hit)
    return hit


def is_meme(symbol: Column) -> Column:
    """Any pattern occurs in the name once quote codes are taken out."""
    base = symbol
    for quote in MEME_QUOTES:
        base = F.replace(base, F.lit(quote), F.lit(""))
    return base.rlike("|".join(MEME_PATTERNS))


def tradable(tickers: DataFrame) -> DataFrame:
    """Liquid, two-sided markets that are neither stable nor commodity pairs."""
    s = F.col("symbol")
    return tickers.where(
        (F.col("volume") >= MIN_QUOTE_VOLUME)
        & (F.col("bid") > 0)
        & (F.col("ask") > 0)
        & ~is_stable_pair(s)
        & ~is_commodity_pair(s)
    )


def universe(tickers: DataFrame, limit: int) -> DataFrame:
    """Top markets by quote volume, tier-1 pairs that missed the cut put in front.

    Both cuts are ordered limits over candidates, never a full sort; the second
    stage holds at most ``limit`` plus the tier-1 rows.
    """
    s = F.col("symbol")
    pool = tickers.where(
        s.endswith("USDT")
        & (F.col("volume") >= MIN_QUOTE_VOLUME)
        & ~is_stable_pair(s)
        & ~is_commodity_pair(s)
        & ~is_meme(s)
    ).select("symbol", "volume")
    top = pool.orderBy(F.desc("volume"), "symbol").limit(limit).withColumn("_forced", F.lit(0))
    anchors = pool.where(s.isin(*[f"{c}USDT" for c in TIER1])).join(top, "symbol", "left_anti")
    both = anchors.withColumn("_forced", F.lit(1)).unionByName(top)
    return both.orderBy(F.desc("_forced"), F.desc("volume"), "symbol").limit(limit).drop("_forced")


def ticker_snapshot(raw: DataFrame) -> DataFrame:
    """Missing ticker fields read as zero."""
    fields = ["price", "volume", "bid", "ask", "change"]
    return raw.select("symbol", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in fields])


def fresh_symbols(universe_df: DataFrame, active: DataFrame, cooling: DataFrame, order: Sequence, limit: int | None):
    """Universe minus symbols with an active trade or a running cooldown."""
    out = universe_df.join(active.select("symbol").distinct(), "symbol", "left_anti").join(
        cooling.select("symbol").distinct(), "symbol", "left_anti"
    )
    return out if limit is None else out.orderBy(*order).limit(limit)
