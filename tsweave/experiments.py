"""Whole experiments over files: each reads, runs the operators and returns a report of plain values."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import CollectionError, InsufficientDataError
from .functions import formula
from .operators import backtest, contracts, costs, coverage, crossfeed, discovery, feeds, montecarlo, multiplicity, special, stats, symbols
from .sources import tables

PREVIEW = 20


def _rows(frame: DataFrame, n: int | None = None) -> list[dict]:
    """A small result as records. n bounds what is shown of a long one."""
    return [r.asDict(recursive=True) for r in (frame.limit(n) if n else frame).collect()]


def report(spark: SparkSession, kind: str, parameters: dict, paths: list[str], results: dict) -> dict:
    sources = _rows(tables.fingerprints(spark, paths))
    return {"manifest": tables.experiment_manifest(kind, parameters, sources), "results": results}


def compare_feeds(spark: SparkSession, path_a: str, path_b: str, *, symbol_a: str, symbol_b: str, canonical: str, cost: float = 0.0, tolerance_ms: float = 100.0, mode: str = "anchor", aggregation: str = "last", gap_ms: float | None = None, latency_ms: float | None = None, contract_a: str | None = None, contract_b: str | None = None, volume: float = 0.1, leverage: float | None = None) -> dict:
    """Two brokers' ticks: alignment, edges, contract gate, execution, episodes, latency and the label of it all."""
    parameters = {k: v for k, v in locals().items() if k not in ("spark", "path_a", "path_b")}
    raw = [feeds.require_one_symbol(tables.load_feed(spark, p, s, canonical)) for p, s in ((path_a, symbol_a), (path_b, symbol_b))]
    a, b = (feeds.prepare_ticks(r, aggregation).cache() for r in raw)
    tolerance = int(tolerance_ms * 1000)
    edges = crossfeed.directional_edges(crossfeed.align(a, b, tolerance, mode), cost).cache()
    specs = [tables.load_contract(spark, p, s) if p else None for p, s in ((contract_a, symbol_a), (contract_b, symbol_b))]
    pair = spark.createDataFrame([tuple(specs)], f"a struct<{_struct(contracts.SCHEMA)}>, b struct<{_struct(contracts.SCHEMA)}>")
    gate = contracts.contract_gate(pair).first()
    widest = edges.orderBy(F.desc("gross_edge"), "t").first()
    if widest is None:
        raise InsufficientDataError("no ticks could be aligned")
    executable = capital = legs = normalized = None
    if specs[0] and specs[1]:
        one = lambda s, price: costs.fill(costs.margin(spark.createDataFrame([s], contracts.SCHEMA).withColumn("volume", F.lit(volume)).withColumn("price", F.lit(float(price))), leverage))
        legs_a, legs_b = one(specs[0], widest.ask), one(specs[1], widest.b_ask)
        assessed = costs.execution(legs_a.select(F.struct(*legs_a.columns).alias("a")).crossJoin(legs_b.select(F.struct(*legs_b.columns).alias("b")))).first()
        executable, capital = assessed.executable, assessed.capital_verified
        if not gate.blocks:
            normalized = _rows(contracts.normalized_summary(contracts.normalize_edge(edges.select("net_edge").crossJoin(F.broadcast(pair)), "net_edge", F.lit(volume))))[0]
            legs = normalized["legs_agree"]
    blocked = gate.blocks or executable is False
    gap = spark.createDataFrame([(canonical, gap_ms)], "symbol string, gap_ms double") if gap_ms is not None else crossfeed.episode_gap(edges, tolerance)
    gap_us = int(gap.first().gap_ms * 1000)
    found = crossfeed.episodes(edges.where("false") if blocked else edges, gap_us).cache()
    survives, latency = None, None
    if latency_ms is not None and not found.isEmpty():
        runs = found.withColumn("peak_edge", F.col("max_net_edge"))
        latency = _rows(costs.latency_report(costs.latency_capture(runs, latency_ms)))[0]
        points = costs.sensitivity_sweep(runs, latency_ms)
        latency |= {"sweep": _rows(points.orderBy("value")), "sensitivity": _rows(costs.fragility(points, latency_ms))[0]}
        survives = latency["capturable"] > 0
    label = crossfeed.classification(gate.status, executable=executable, capital_verified=capital, survives=survives, legs_agree=legs)
    summary = _rows(crossfeed.tick_summary(a, b, edges, found, label))[0] | _rows(crossfeed.tick_details(*raw, edges, blocked=blocked))[0]
    summary |= {"symbol": canonical, "mode": mode, "aggregation": aggregation, "additional_cost": cost, "contract_status": gate.status, "contract_issues": gate.issues, "contract_advisories": gate.advisories}
    summary |= {"normalization_applied": gate.status == contracts.NORMALIZE and not blocked, "normalized": normalized}
    shown = tables.preview(edges, "UTC", PREVIEW)
    return report(spark, "compare_feeds", parameters, [path_a, path_b], {"summary": summary, "contracts": gate.asDict() | {"a": None, "b": None}, "opportunities": _rows(found.orderBy("start_us"), 1_000), "latency": latency, "gap_ms": gap_us / 1000, "aligned": _rows(shown)})


def _struct(schema: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in schema.split(", ")))


def discover(spark: SparkSession, path: str, *, least_symbols: int = 2, least_rows: int = 30, method: str = "fdr_bh", alpha: float = 0.05, most: int = 50) -> dict:
    """A panel: coverage, shared window, candidates without repeats, their histories, cointegration, ranking and verdicts."""
    parameters = {k: v for k, v in locals().items() if k not in ("spark", "path")}
    panel = tables.load_panel(spark, path).cache()
    window = coverage.require_usable(coverage.shared_window(panel, least_symbols), least_rows)
    names = window["symbols"]
    inside = coverage.slice_of(panel, window["start"], window["end"])
    wide = coverage.pivoted(inside, names).dropna().cache()
    known = discovery.expand(discovery.catalog(spark), names)
    made, left_out = discovery.candidates(names, most)
    rows = [(r.name, r.formula) for r in known.select("name", "formula").collect()] + made
    kept = [(r.name, r.formula) for r in discovery.deduplicate(spark, rows).where("kept_as is null").orderBy("position").collect()]
    # a candidate's target is a symbol of its name, or the first symbol that its formula hasn't
    triples = []
    for name, text in kept:
        others = [s for s in names if s not in formula.parse(text).symbols()]
        if name in names or others:
            triples.append((name, name if name in names else others[0], text))
    histories, without = discovery.evaluate(wide, names, triples)
    if histories is None:
        raise InsufficientDataError("no candidate can be evaluated on this panel")
    histories = histories.cache()
    tests = special.cointegration_by_name(histories.select("name", "t", F.col("actual").alias("y"), F.col("synthetic").alias("x"))).cache()
    family = multiplicity.build_family(tests.select(F.col("name").alias("label"), F.col("adf_p").alias("p_value"), "tests_agree")).withColumn("position", F.hash("label"))
    verdicts = multiplicity.adjust(family, method, alpha)
    ranking = discovery.rank_candidates(histories)
    candidates = tables.candidates_with_verdicts(discovery.statuses(histories).join(stats.error_metrics(histories), "name").join(tests.drop("n"), "name"), verdicts)
    regimes = stats.regime_summary(stats.regimes(inside, "close", ["symbol"], stats.Z_WINDOW), ("symbol",))
    return report(spark, "discover", parameters, [path], {
        "window": window, "coverage": _rows(coverage.symbol_coverage(panel)), "candidates": _rows(candidates.orderBy("name")), "without": [{"name": n, "status": s, "reason": r} for n, s, r in without],
        "left_out": left_out, "ranking": _rows(ranking.orderBy("rank")) if ranking is not None else None, "family": _rows(multiplicity.family_report(verdicts, alpha))[0] if verdicts.count() else None, "regimes": _rows(regimes),
    })


def run_backtest(spark: SparkSession, path: str, *, convention: str = "earned_over_following_bar") -> dict:
    rows = tables.load_experiment(spark, path, ("signal", "gross_edge", "cost"))
    made = backtest.trades(rows, convention=convention)
    return report(spark, "backtest", {"convention": convention}, [path], {"metrics": _rows(backtest.metrics(made))[0], "trades": _rows(made.orderBy("decision_t"), 1_000)})


def run_ensemble(spark: SparkSession, path: str, *, weights: dict[str, float], threshold: float) -> dict:
    rows = tables.load_experiment(spark, path, (*weights, "gross_edge", "cost"))
    return report(spark, "multi_backtest", {"weights": weights, "threshold": threshold}, [path], {"stages": _rows(backtest.metrics(backtest.ensemble(rows, weights, threshold), ("stage",)))})


def run_walk_forward(spark: SparkSession, path: str, *, thresholds: tuple[float, ...], train: int, validation: int, test: int, step: int | None = None) -> dict:
    rows = tables.load_experiment(spark, path, ("signal", "gross_edge", "cost"))
    chosen, made = backtest.walk_forward(rows, thresholds, train, validation, test, step)
    parameters = {"thresholds": list(thresholds), "train": train, "validation": validation, "test": test, "step": step}
    return report(spark, "walk_forward", parameters, [path], {"folds": _rows(chosen.orderBy("fold")), "metrics": _rows(backtest.metrics(backtest.once_each(made)))[0]})


def run_robustness(spark: SparkSession, path: str, *, simulations: int = 500, block: int = 5, seed: int = 7, confidence: float = 0.95) -> dict:
    made = backtest.trades(tables.load_experiment(spark, path, ("signal", "gross_edge", "cost")))
    runs = montecarlo.simulate(made, simulations, block, seed)
    return report(spark, "robustness", {"simulations": simulations, "block": block, "seed": seed}, [path], {"scenarios": _rows(montecarlo.distribution(runs, confidence).orderBy("scenario"))})


def research(spark: SparkSession, path: str, *, target: str, text: str) -> dict:
    """A formula against a target on stored bars."""
    panel = tables.load_panel(spark, path)
    names = sorted({target, *formula.parse(text).symbols()})
    wide = coverage.pivoted(panel.where(F.col("symbol").isin(names)), names).dropna()
    h = discovery.history(wide, names, "candidate", target, text)
    pairs = h.select(F.lit("candidate").alias("name"), "t", F.col("actual").alias("y"), F.col("synthetic").alias("x"))
    return report(spark, "research", {"target": target, "formula": text}, [path], {"errors": _rows(stats.error_metrics(h))[0], "correlation": _rows(stats.correlation(h, "actual", "synthetic"))[0], "half_life": _rows(stats.half_life(stats.ar1(h, "discrepancy", ["name"], ["t"]))), "cointegration": _rows(special.cointegration_by_name(pairs)), "beta": _rows(stats.beta_summary(h.withColumnRenamed("rolling_beta", "beta")))})


def collect_feed(rows: DataFrame, folder: str, broker_profile: str) -> dict:
    """Check ticks and append them to a dataset; repeated ticks pass, anything else that is wrong refuses all."""
    from .errors import DataQualityError

    counts = feeds.tick_quality(rows).first().asDict()
    wrong = {k: v for k, v in counts.items() if v and k not in ("rows", "duplicates")}
    if wrong or not counts["rows"]:
        raise DataQualityError(f"ticks are refused: {wrong or 'there are none'}")
    named = rows.withColumn("t", F.unix_micros(F.expr("try_cast(timestamp as timestamp)")))
    return tables.write_dataset(named, folder, broker_profile=broker_profile, data_type="ticks") | {"quality": counts}


def collect_all(spark: SparkSession, jobs: list[tuple[str, str, str]], folder: str, *, workers: int = 4, retries: int = 2, wait_s: float = 0.1) -> list[dict]:
    """Collect every job (broker profile, symbol, path of its ticks), several at a time, and return the manifests in order.

    A job that can't be read is tried again; one whose ticks are refused is not. All jobs are ended before an error that
    names every failed one is raised; what the others wrote stays.
    """
    from .errors import DataQualityError

    def one(job: tuple[str, str, str]) -> dict | str:
        profile, symbol, path = job
        for attempt in range(retries + 1):
            try:
                rows = tables.read_any(spark, path).where(F.col("symbol") == symbol)
                return collect_feed(rows, folder, profile)
            except DataQualityError as e:
                return f"{profile}/{symbol}: {e}"
            except Exception as e:  # noqa: BLE001  a source can fail in any way
                if attempt == retries:
                    return f"{profile}/{symbol}: {type(e).__name__} after {attempt + 1} attempts"
                time.sleep(wait_s)
        raise AssertionError

    with ThreadPoolExecutor(max(1, workers)) as pool:
        done = list(pool.map(one, jobs))
    if failed := [x for x in done if isinstance(x, str)]:
        raise CollectionError("; ".join(failed))
    return done


def search_symbols(spark: SparkSession, path: str, *, search: str | None = None, everything: bool = False, visible_only: bool = False) -> dict:
    """The symbols of a stored catalog that match, or all; those that can't be traded only where everything is asked for."""
    rows = tables.load_catalog(spark, path)
    if not everything:
        rows = rows.where(symbols.is_tradable())
    if visible_only:
        rows = rows.where("visible")
    rows = rows.withColumn("mode", symbols.trade_mode_name())
    found = symbols.search(rows, search).orderBy("rank") if search else rows.orderBy("position")
    return report(spark, "symbols", {"search": search, "everything": everything, "visible_only": visible_only}, [path], {"symbols": _rows(found)})


def resolve_symbols(spark: SparkSession, path: str, *, names: tuple[str, ...] = tuple(symbols.ALIASES)) -> dict:
    """For each canonical name the symbol of a stored catalog and the reason, or neither."""
    catalog = tables.load_catalog(spark, path).select(F.col("name").alias("symbol"), "position").cache()
    found = {}
    for name in names:
        one = symbols.resolve(catalog, name).first()
        found[name] = {"symbol": one.symbol, "reason": one.reason} if one else {"symbol": None, "reason": None}
    return report(spark, "resolve_symbols", {"names": list(names)}, [path], {"resolved": found})


def symbol_specs(spark: SparkSession, path: str, *, symbol: str | None = None) -> dict:
    """The stored specification of a symbol."""
    return report(spark, "symbol_specs", {"symbol": symbol}, [path], {"specification": tables.load_contract(spark, path, symbol).asDict()})
