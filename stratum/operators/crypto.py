"""Crypto prices: candles and ticks from bronze to gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions.scalar import guarded_ratio

from .change import latest_by

#: The candle file's columns, and the two versions of a tick.
KLINE_SCHEMA = "open_time_raw bigint, open double, high double, low double, close double, volume double, close_time_raw bigint, quote_asset_volume double, number_of_trades bigint, taker_buy_base_asset_volume double, taker_buy_quote_asset_volume double, ignore string"
TICK_V1 = "event_id string, symbol string, price_usd double, event_time string, producer_id string, source_system string"
EXTRA = ["change_pct_24h", "high_price_24h", "low_price_24h", "volume_24h"]
TICK_V2 = TICK_V1 + "".join(f", {c} double" for c in EXTRA)


def bronze_klines(raw: DataFrame, *, interval: str = "1d", source_system: str = "binance_historical") -> DataFrame:
    """Candles with times from microseconds and the symbol from the file's name.

    ``raw`` must be a file scan, for its hidden metadata. The record id is of
    symbol and raw opening time.
    """
    name, symbol = F.col("_metadata.file_name"), F.regexp_extract(F.col("_metadata.file_name"), r"^([A-Z0-9]+)-1d-", 1)
    second = lambda c: F.timestamp_seconds(F.floor(F.col(c) / 1_000_000))
    amounts = ["open", "high", "low", "close", "volume", "quote_asset_volume", "number_of_trades", "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume"]
    return raw.select(
        F.sha2(F.concat_ws("|", symbol, F.col("open_time_raw").cast("string")), 256).alias("record_id"),
        symbol.alias("symbol"),
        F.lit(interval).alias("interval"),
        second("open_time_raw").alias("open_time"),
        second("close_time_raw").alias("close_time"),
        *amounts,
        "open_time_raw",
        "close_time_raw",
        F.lit(source_system).alias("source_system"),
        name.alias("source_file_name"),
        F.col("_metadata.file_path").alias("source_file_path"),
        F.current_timestamp().alias("ingested_at"),
    )


def silver_klines(rows: DataFrame) -> DataFrame:
    """Sound candles, the latest of each (symbol, open time), with what follows from them."""
    prices = ["symbol", "open_time", "open", "high", "low", "close"]
    sound = F.lit(True)
    for c in prices:
        sound = sound & F.col(c).isNotNull()
    kept = latest_by(rows.filter(sound & (F.col("high") >= F.col("low")) & (F.col("volume") >= 0)), ["symbol", "open_time"], ["ingested_at"])
    change = F.col("close") - F.col("open")
    return kept.withColumns(
        {
            "trade_date": F.to_date("open_time"),
            "price_change": change,
            "price_change_pct": guarded_ratio(change, F.col("open")) * 100,
            "candle_range": F.col("high") - F.col("low"),
            "candle_direction": F.when(change > 0, "BULLISH").when(change < 0, "BEARISH").otherwise("NEUTRAL"),
        }
    )


def parse_ticks(messages: DataFrame, *, evolved: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ticks parsed from ``value``: those with id, symbol, time and a positive price, and the rest."""
    parsed = messages.withColumn("raw_json", F.col("value").cast("string")).withColumn("t", F.from_json("raw_json", TICK_V2 if evolved else TICK_V1))
    rows = parsed.select("t.*", F.col("partition").alias("eventhub_partition"), F.col("offset").alias("eventhub_offset"), F.col("timestamp").alias("eventhub_enqueued_at"), "raw_json", F.current_timestamp().alias("ingested_at"))
    rows = rows.withColumn("event_time", F.try_to_timestamp("event_time"))
    return rows.filter(_sound_tick()), rows.filter(~_sound_tick())


def _sound_tick() -> Column:
    whole = F.col("event_id").isNotNull() & F.col("symbol").isNotNull() & F.col("event_time").isNotNull()
    return F.coalesce(whole & (F.col("price_usd") > 0), F.lit(False))


def silver_ticks(rows: DataFrame) -> DataFrame:
    """Sound ticks once by event, then once by place in the stream, with date, minute and delay.

    Fields of the second version are null where the table has none.
    """
    wide = rows.filter(_sound_tick()).withColumns({c: F.lit(None).cast("double") for c in EXTRA if c not in rows.columns})
    once = latest_by(wide, ["event_id"], ["ingested_at", "eventhub_offset"])
    twice = latest_by(once, ["eventhub_partition", "eventhub_offset"], ["ingested_at", "event_id"])
    delay = F.col("ingested_at").cast("timestamp").cast("long") - F.col("event_time").cast("timestamp").cast("long")
    out = twice.withColumns({"event_date": F.to_date("event_time"), "event_minute": F.date_trunc("minute", "event_time"), "ingestion_delay_seconds": delay})
    first = ["event_id", "symbol", "price_usd", "event_time", "event_date", "event_minute", *EXTRA]
    return out.select(*first, *[c for c in ("producer_id", "source_system", "eventhub_partition", "eventhub_offset", "eventhub_enqueued_at", "ingested_at", "ingestion_delay_seconds") if c in out.columns])


def _pct(part: Column, whole: Column) -> Column:
    return guarded_ratio(part - whole, whole) * 100


def latest_prices(klines: DataFrame, ticks: DataFrame) -> DataFrame:
    """The last tick of each symbol beside its last close; symbols without ticks have no row."""
    live = latest_by(ticks.select("symbol", "event_time", "ingested_at", "price_usd", *EXTRA), ["symbol"], ["event_time", "ingested_at"])
    last = klines.groupBy("symbol").agg(F.max(F.struct("open_time", "ingested_at", "trade_date", "close", "price_change_pct")).alias("k"))
    both = live.join(last, "symbol", "left")
    price, close = F.col("price_usd"), F.col("k.close")
    return both.select(
        "symbol",
        price.alias("latest_live_price"),
        F.col("event_time").alias("latest_live_event_time"),
        F.col("k.trade_date").alias("latest_historical_date"),
        close.alias("latest_historical_close"),
        F.col("k.price_change_pct").alias("latest_historical_change_pct"),
        (price - close).alias("price_difference"),
        _pct(price, close).alias("price_difference_pct"),
        *EXTRA,
        F.current_timestamp().alias("gold_updated_at"),
    )


def market_summary(klines: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per symbol the period's candles, the ticks and the latest price; symbols without candles have no row."""
    way = lambda d: F.count_if(F.col("candle_direction") == d)
    h = klines.groupBy("symbol").agg(
        F.min("trade_date").alias("historical_start_date"),
        F.max("trade_date").alias("historical_end_date"),
        F.min_by("open", "open_time").alias("first_open_price"),
        F.max_by("close", "open_time").alias("last_close_price"),
        F.min("low").alias("period_minimum_low"),
        F.max("high").alias("period_maximum_high"),
        F.sum("volume").alias("period_total_volume"),
        F.sum("number_of_trades").alias("period_total_trades"),
        F.avg("price_change_pct").alias("average_daily_change_pct"),
        way("BULLISH").alias("bullish_days"),
        way("BEARISH").alias("bearish_days"),
        way("NEUTRAL").alias("neutral_days"),
    )
    h = h.withColumn("historical_return_pct", _pct(F.col("last_close_price"), F.col("first_open_price")))
    s = ticks.groupBy("symbol").agg(
        F.count("*").alias("streaming_event_count"),
        F.min("event_time").alias("first_streaming_event_time"),
        F.max("event_time").alias("latest_streaming_event_time"),
        F.min("price_usd").alias("streaming_minimum_price"),
        F.max("price_usd").alias("streaming_maximum_price"),
        F.avg("price_usd").alias("streaming_average_price"),
        F.avg("ingestion_delay_seconds").alias("average_ingestion_delay_seconds"),
        F.count("change_pct_24h").alias("evolved_event_count"),
    )
    latest = latest_prices(klines, ticks).select("symbol", "latest_live_price", "latest_live_event_time", "price_difference", "price_difference_pct", *EXTRA)
    out = h.join(s, "symbol", "left").join(latest, "symbol", "left")
    price, high, low = F.col("latest_live_price"), F.col("period_maximum_high"), F.col("period_minimum_low")
    return out.withColumns({"historical_price_range": high - low, "latest_vs_period_high_pct": _pct(price, high), "latest_vs_period_low_pct": _pct(price, low), "gold_updated_at": F.current_timestamp()})


def ohlc_violations(rows: DataFrame) -> DataFrame:
    """One row of counts of candles that contradict themselves."""
    c = F.col
    return rows.agg(
        F.count_if(c("high") < c("low")).alias("high_below_low"),
        F.count_if((c("open") > c("high")) | (c("open") < c("low"))).alias("open_outside"),
        F.count_if((c("close") > c("high")) | (c("close") < c("low"))).alias("close_outside"),
        F.count_if(c("volume") < 0).alias("negative_volume"),
        F.count_if(c("close_time") <= c("open_time")).alias("time_order"),
    )


def dashboard(klines: DataFrame, summary: DataFrame, prices: DataFrame) -> dict[str, DataFrame]:
    """Datasets of the market dashboard."""
    return {
        "symbols": summary.select("symbol", "historical_return_pct", "average_daily_change_pct").orderBy(F.desc_nulls_last("historical_return_pct")),
        "kpis": summary.agg(F.count("*").alias("symbols"), F.sum("period_total_volume").alias("volume"), F.sum("period_total_trades").alias("trades"), F.sum("streaming_event_count").alias("ticks")),
        "latest_prices": prices.orderBy("symbol"),
        "closes": klines.select("symbol", "trade_date", "close").orderBy("symbol", "trade_date"),
        "volumes": klines.groupBy("trade_date").agg(F.sum("volume").alias("volume")).orderBy("trade_date"),
        "daily_change": klines.select("symbol", "trade_date", "price_change_pct").orderBy("symbol", "trade_date"),
        "directions": klines.groupBy("symbol", "candle_direction").agg(F.count("*").alias("days")).orderBy("symbol", "candle_direction"),
        "ranges": klines.groupBy("symbol").agg(F.avg("candle_range").alias("average_range"), F.max("candle_range").alias("largest_range")).orderBy("symbol"),
        "top_moves": klines.select("symbol", "trade_date", "price_change_pct").orderBy(F.desc(F.abs("price_change_pct")), "symbol", "trade_date").limit(10),
        "delays": summary.select("symbol", "average_ingestion_delay_seconds", "evolved_event_count").orderBy("symbol"),
    }
