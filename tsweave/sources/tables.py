"""Reading and writing panels, feeds, logs, contracts, datasets and reports. Types are stated, never inferred."""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from datetime import UTC, date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigurationError, DataQualityError
from ..functions.columns import micros
from ..operators.contracts import SCHEMA as CONTRACT_SCHEMA
from ..operators.symbols import safe_name

TIMEFRAMES = ("M1", "M5", "M15", "M30", "H1", "H4", "D1")
TICKS = "timestamp string, source_timestamp string, broker string, symbol string, bid double, ask double, mid double, spread double, volume double, source string"


def read_text_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, every column as text, so that symbols like 000300 stay as they are."""
    names = spark.read.option("header", True).csv(path, inferSchema=False).columns
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).option("header", True).csv(path)


def read_any(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else read_text_csv(spark, path)


def load_panel(spark: SparkSession, path: str) -> DataFrame:
    """A wide or long panel file as (t, symbol, close), checked: readable times, no repeats, positive numbers, some rows.

    A file with symbol and close is long; else every column but timestamp is a symbol. Absent values give no row.
    """
    raw = read_any(spark, path)
    if "timestamp" not in raw.columns:
        raise DataQualityError("a panel has a timestamp column")
    raw = raw.withColumn("t", micros(F.expr("try_cast(timestamp as timestamp)"))).drop("timestamp")
    if {"symbol", "close"} <= set(raw.columns):
        long = raw.select("t", F.col("symbol").cast("string").alias("symbol"), F.col("close").cast("string").alias("c"))
        keys = ["t", "symbol"]
        repeated = not long.groupBy(*keys).count().where("count > 1").isEmpty()
    else:
        names = [c for c in raw.columns if c != "t"]
        if not names:
            raise DataQualityError("a panel has a symbol at least")
        repeated = not raw.groupBy("t").count().where("count > 1").isEmpty()
        long = raw.select("t", *[F.col(f"`{c}`").cast("string").alias(c) for c in names]).unpivot("t", names, "symbol", "c")
    value = F.expr("try_cast(nullif(trim(c), '') as double)")
    checks = long.agg(F.count("*").alias("n"), F.count_if(F.col("t").isNull()).alias("no_time"), F.count_if(F.trim("c") != F.lit("")).alias("given"), F.count_if(value.isNotNull() & ~F.isnan(value)).alias("numbers"), F.count_if(value <= 0).alias("low")).first()
    for bad, what in ((repeated, "a time is repeated"), (not checks.n, "the panel is empty"), (checks.no_time, "a time can't be read"), (checks.given > checks.numbers + long.where("lower(trim(c)) = 'nan'").count(), "a price isn't a number"), (checks.low, "a price isn't positive")):
        if bad:
            raise DataQualityError(what)
    return long.select("t", "symbol", value.alias("close")).where("close is not null and not isnan(close)")


def load_feed(spark: SparkSession, path: str, symbol: str, canonical: str) -> DataFrame:
    """The rows of one symbol of a broker's file under the canonical name; the broker's own stays as broker_symbol.

    seq is the place in the file as far as Spark numbers rows: it orders rows of equal time.
    """
    raw = read_any(spark, path)
    seq = F.monotonically_increasing_id()
    out = raw.withColumn("seq", seq)
    if "symbol" in raw.columns:
        out = out.where(F.col("symbol") == symbol)
    own = F.col("symbol") if "symbol" in raw.columns else F.lit(symbol)
    numbers = {c: F.expr(f"try_cast({c} as double)") for c in ("bid", "ask", "close") if c in raw.columns}
    return out.withColumn("broker_symbol", own).withColumn("symbol", F.lit(canonical)).withColumn("t", micros(F.expr("try_cast(timestamp as timestamp)"))).withColumns(numbers)


def load_experiment(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    """An experiment's rows (t and the required numbers), with unique readable times."""
    raw = read_any(spark, path)
    if missing := [c for c in ("timestamp", *required) if c not in raw.columns]:
        raise DataQualityError(f"columns are missing: {', '.join(missing)}")
    out = raw.select(micros(F.expr("try_cast(timestamp as timestamp)")).alias("t"), *[F.expr(f"try_cast({c} as double)").alias(c) for c in required])
    if not out.where("t is null").isEmpty() or not out.groupBy("t").count().where("count > 1").isEmpty():
        raise DataQualityError("times must be readable and unique")
    return out


def load_latency(spark: SparkSession, path: str, symbol: str | None = None, broker: str | None = None) -> DataFrame:
    """(round_trip_ms, symbol, broker) of a CSV, Parquet or JSON log; JSON may wrap its list in samples, records or data."""
    if path.endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        for key in ("samples", "records", "data"):
            if key in raw.columns and isinstance(raw.schema[key].dataType, T.ArrayType):
                raw = raw.select(F.explode(key).alias("r")).select("r.*")
                break
    else:
        raw = read_any(spark, path)
    names = [c for c in ("round_trip_ms", "round_trip", "latency_ms") if c in raw.columns]
    if not names:
        raise DataQualityError("a latency log has round_trip_ms, round_trip or latency_ms")
    pick = lambda c: F.col(c).cast("string") if c in raw.columns else F.lit(None).cast("string")
    out = raw.select(F.coalesce(*[F.expr(f"try_cast({c} as double)") for c in names]).alias("round_trip_ms"), pick("symbol").alias("symbol"), pick("broker").alias("broker")).where("round_trip_ms > 0 and not isnan(round_trip_ms)")
    for c, v in (("symbol", symbol), ("broker", broker)):
        if v is not None:
            out = out.where(F.col(c).isNull() | (F.lower(c) == v.lower()))
    return out


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A stored catalog of symbols: position, name, description, path, visible, trade_mode. Columns that a file hasn't are null; visible is then true."""
    raw = read_any(spark, path)
    if "name" not in raw.columns:
        raise DataQualityError("a catalog has a name column")
    pick = lambda c, kind: F.col(c).cast(kind) if c in raw.columns else F.lit(None).cast(kind)
    place = pick("position", "long") if "position" in raw.columns else F.monotonically_increasing_id()
    return raw.select(place.alias("position"), F.col("name").cast("string").alias("name"), pick("description", "string").alias("description"), pick("path", "string").alias("path"), F.coalesce(pick("visible", "boolean"), F.lit(True)).alias("visible"), pick("trade_mode", "int").alias("trade_mode"))


def load_contract(spark: SparkSession, path: str, symbol: str | None = None):
    """The one contract of a JSON object or list, by symbol without regard to case; none or several is an error."""
    rows = spark.read.schema(CONTRACT_SCHEMA).option("multiLine", True).json(path)
    if symbol is not None:
        rows = rows.where(F.lower("symbol") == symbol.lower())
    found = rows.limit(2).collect()
    if len(found) != 1:
        raise ConfigurationError("no contract matches" if not found else "several contracts match")
    return found[0]


def newest(rows: DataFrame, n: int) -> DataFrame:
    """The newest n rows, in order of time."""
    return rows.orderBy(F.desc("t"), F.desc("seq")).limit(n).orderBy("t", "seq")


def write_dataset(rows: DataFrame, folder: str, *, broker_profile: str, data_type: str, timeframe: str = "tick") -> dict:
    """Append rows (with symbol) under folder, partitioned, and return the manifest; Spark's committer makes it whole or not at all."""
    if timeframe != "tick" and timeframe not in TIMEFRAMES:
        raise ConfigurationError(f"timeframe is tick or one of {TIMEFRAMES}")
    named = rows.withColumns({"broker_profile": safe_name(F.lit(broker_profile)), "data_type": F.lit(data_type), "timeframe": F.lit(timeframe), "symbol": safe_name(F.col("symbol"))})
    identifier = "DATA-" + uuid.uuid4().hex[:8]
    named.withColumn("dataset_id", F.lit(identifier)).write.mode("append").partitionBy("broker_profile", "data_type", "symbol", "timeframe", "dataset_id").parquet(folder)
    total = rows.agg(F.count("*").alias("rows"), F.min("t").alias("first_t"), F.max("t").alias("last_t")).first()
    return {"dataset_id": identifier, "broker_profile": broker_profile, "data_type": data_type, "timeframe": timeframe, **total.asDict()}


def read_dataset(spark: SparkSession, folder: str, identifier: str | None = None) -> DataFrame:
    rows = spark.read.parquet(folder)
    return rows.where(F.col("dataset_id") == identifier) if identifier else rows


def fingerprints(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, sha256, bytes) of source files, hashed where they lie."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def experiment_manifest(experiment_type: str, parameters: dict, sources: list[dict]) -> dict:
    return {"experiment_id": "EXP-" + uuid.uuid4().hex[:8], "experiment_type": experiment_type, "created_at": datetime.now(UTC).isoformat(), "parameters": parameters, "sources": sources}


def _jsonable(x):
    import numpy as np

    if isinstance(x, (datetime, date)):
        return x.isoformat()
    if isinstance(x, (np.integer, np.floating, np.bool_)):
        return x.item()
    if isinstance(x, (set, frozenset, tuple)):
        return sorted(x) if not isinstance(x, tuple) else list(x)
    if hasattr(x, "asDict"):
        return x.asDict(recursive=True)
    raise TypeError(f"can't write {type(x).__name__} as JSON")


def write_report(report: dict, folder: str) -> str:
    """A report as EXP-….json in a local folder: written beside and renamed, so that no reader sees half of it."""
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, f"{report['manifest']['experiment_id']}.json")
    with open(f"{path}.tmp", "w") as f:
        json.dump(report, f, default=_jsonable, indent=1, allow_nan=False)
    os.replace(f"{path}.tmp", path)
    return path


def list_reports(spark: SparkSession, folder: str, experiment_type: str | None = None) -> DataFrame:
    """(path, experiment_id, experiment_type, created_at), newest first; files that can't be read are left out."""
    raw = spark.read.text(f"{folder}/EXP-*.json", wholetext=True).withColumn("path", F.input_file_name())
    m = F.from_json(F.get_json_object("value", "$.manifest"), "experiment_id string, experiment_type string, created_at string")
    out = raw.withColumn("m", m).where("m.experiment_id is not null").select("path", "m.*")
    if experiment_type:
        out = out.where(F.col("experiment_type") == experiment_type)
    return out.orderBy(F.desc("created_at"), F.desc("experiment_id"))


def report_rows(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """The records under results.key of a report as a frame; numbers that are absent or no numbers are null."""
    raw = spark.read.text(path, wholetext=True)
    items = F.from_json(F.get_json_object("value", f"$.results.{key}"), f"array<struct<{schema}>>")
    return raw.select(F.explode(items).alias("r")).select("r.*")


def candidates_with_verdicts(candidates: DataFrame, hypotheses: DataFrame) -> DataFrame:
    """Candidates with the verdict of their hypothesis, null where none was tested: not tested isn't failed."""
    return candidates.join(hypotheses.select(F.col("label").alias("name"), "adjusted_p", "rejected"), "name", "left")


def local_sha256(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def preview(rows: DataFrame, zone: str, n: int = 20) -> DataFrame:
    """The first n rows with their time rendered in a zone."""
    local = F.from_utc_timestamp(F.timestamp_micros("t"), zone)
    return rows.orderBy("t").limit(n).withColumn("local_time", F.date_format(local, "yyyy-MM-dd HH:mm:ss"))
