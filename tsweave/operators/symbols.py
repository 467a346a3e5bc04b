"""Symbol names of brokers: normalising, matching, searching and comparing catalogs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What symbols are also called, by canonical name.
ALIASES = {
    "XAUUSD": ("gold", "xau"),
    "XAGUSD": ("silver", "xag"),
    "EURUSD": ("eurusd", "eur.usd", "eur/usd"),
    "GBPUSD": ("gbpusd", "gbp.usd", "gbp/usd"),
    "USDJPY": ("usdjpy", "usd.jpy", "usd/jpy"),
    "EURGBP": ("eurgbp", "eur.gbp", "eur/gbp"),
    "EURJPY": ("eurjpy", "eur.jpy", "eur/jpy"),
    "GBPJPY": ("gbpjpy", "gbp.jpy", "gbp/jpy"),
    "XAUEUR": ("xaueur", "xau.eur", "xau/eur", "gold.eur", "gold/eur"),
}
#: Trade modes by number.
TRADE_MODES = {0: "disabled", 1: "long_only", 2: "short_only", 3: "close_only", 4: "full"}


def normalized(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def _plain(text: str) -> str:
    return re.sub("[^a-z0-9]", "", text.lower())


def holds_word(text: Column, word: str) -> Column:
    """Whether text holds the word with no letter or digit right beside it."""
    return F.lower(text).rlike(r"(?<![\p{L}\p{N}])" + re.escape(word.lower()) + r"(?![\p{L}\p{N}])") if word else F.lit(False)


def is_tradable(mode: str = "trade_mode") -> Column:
    """Known and not disabled; null is not tradable."""
    return F.coalesce(F.col(mode) != 0, F.lit(False))


def trade_mode_name(mode: str = "trade_mode") -> Column:
    names = F.create_map(*[x for k, v in TRADE_MODES.items() for x in (F.lit(k), F.lit(v))])
    return F.when(F.col(mode).isNotNull(), F.coalesce(F.try_element_at(names, F.col(mode)), F.lit("unknown")))


def spread_in_points() -> Column:
    return F.col("spread").cast("double")


def resolve(catalog: DataFrame, canonical: str, configured: str | None = None) -> DataFrame:
    """(symbol, reason): the catalog's name for a canonical symbol: as configured, else by normalised name, else by alias.

    catalog: (symbol, position). Of several with the normalised name the last by position counts; aliases go in their
    order and then by position.
    """
    aliases = ALIASES.get(canonical, (canonical.lower(),))
    by_alias = F.coalesce(*[F.when(holds_word(F.col("symbol"), a), i) for i, a in enumerate(aliases)])
    rank = F.when(F.col("symbol") == F.lit(configured), 0).when(normalized(F.col("symbol")) == _plain(canonical), 1).otherwise(2 + by_alias)
    found = catalog.withColumn("rank", rank).where("rank is not null")
    found = found.orderBy("rank", F.when(F.col("rank") == 1, -F.col("position")).otherwise(F.col("position"))).limit(1)
    return found.select("symbol", F.when(F.col("rank") == 0, "configuration").when(F.col("rank") == 1, "normalized_name").otherwise("alias").alias("reason"))


def search(catalog: DataFrame, query: str) -> DataFrame:
    """catalog (name, description) rows that match, with reason and rank: exact name, name, alias, description."""
    q = _plain(query)
    name, text = normalized(F.col("name")), normalized(F.coalesce(F.col("description"), F.lit("")))
    alias = F.lit(False)
    for canonical, others in ALIASES.items():
        if any(q in _plain(a) for a in others):
            alias = alias | holds_word(F.col("name"), canonical)
    reason = F.when(name == q, 0).when(holds_word(F.col("name"), query), 1).when(alias, 2).when(text.contains(q), 3)
    quality = F.when(F.col("_r") == 0, 400).when(F.col("_r") == 1, F.when(name.startswith(q), 200).otherwise(100)).when(F.col("_r") == 2, 150).otherwise(F.greatest(F.lit(1), 91 - F.instr(text, q)))
    found = catalog.withColumn("_r", reason).where("_r is not null").withColumn("quality", quality)
    labels = F.array(*[F.lit(x) for x in ("exact_name", "name", "alias", "description")])
    w = Window.orderBy("_r", F.desc("quality"), F.length("name"), F.upper("name"))
    return found.withColumn("rank", F.row_number().over(w)).withColumn("reason", F.element_at(labels, F.col("_r") + 1)).drop("_r")


def shared_symbols(catalogs: DataFrame, profiles: int) -> DataFrame:
    """catalogs (profile, symbol): the normalised names that all profiles have."""
    return catalogs.groupBy(normalized(F.col("symbol")).alias("symbol")).agg(F.count_distinct("profile").alias("n")).where(F.col("n") >= profiles).select("symbol")


def union_in_order(explicit: list[str], named: list[str]) -> list[str]:
    """Both lists without repeats, in order of first mention."""
    return list(dict.fromkeys([*explicit, *named]))


def safe_name(name: Column) -> Column:
    """A name fit for a path."""
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def described(result: DataFrame) -> DataFrame:
    return result.select(F.concat_ws("  ", F.col("rank").cast("string"), "name", "reason", F.coalesce("description", F.lit(""))).alias("line"))
