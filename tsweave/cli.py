"""Commands over files: python -m tsweave.cli COMMAND ... Each writes a report and prints its path."""

from __future__ import annotations

import argparse

from . import experiments
from .session import get_session
from .sources.tables import write_report


def _floats(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(","))


def _weights(text: str) -> dict[str, float]:
    return {k: float(v) for k, _, v in (x.partition("=") for x in text.split(","))}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tsweave")
    top.add_argument("--reports", default="reports")
    sub = top.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compare-feeds")
    c.add_argument("path_a")
    c.add_argument("path_b")
    for name in ("symbol-a", "symbol-b", "canonical"):
        c.add_argument(f"--{name}", required=True)
    for name, kind in (("cost", float), ("tolerance-ms", float), ("gap-ms", float), ("latency-ms", float), ("volume", float), ("leverage", float), ("contract-a", str), ("contract-b", str)):
        c.add_argument(f"--{name}", type=kind, default=argparse.SUPPRESS)
    c.add_argument("--mode", choices=("anchor", "symmetric"), default="anchor")
    c.add_argument("--aggregation", choices=("last", "none"), default="last")
    d = sub.add_parser("discover")
    d.add_argument("path")
    d.add_argument("--method", default="fdr_bh")
    for name, kind in (("least-symbols", int), ("least-rows", int), ("alpha", float), ("most", int)):
        d.add_argument(f"--{name}", type=kind, default=argparse.SUPPRESS)
    b = sub.add_parser("backtest")
    b.add_argument("path")
    b.add_argument("--convention", default="earned_over_following_bar")
    m = sub.add_parser("multi-backtest")
    m.add_argument("path")
    m.add_argument("--weights", type=_weights, required=True)
    m.add_argument("--threshold", type=float, default=0.0)
    w = sub.add_parser("walk-forward")
    w.add_argument("path")
    w.add_argument("--thresholds", type=_floats, default=(0.0,))
    for name in ("train", "validation", "test"):
        w.add_argument(f"--{name}", type=int, required=True)
    w.add_argument("--step", type=int)
    r = sub.add_parser("robustness")
    r.add_argument("path")
    for name in ("simulations", "block", "seed"):
        r.add_argument(f"--{name}", type=int, default=argparse.SUPPRESS)
    s = sub.add_parser("research")
    s.add_argument("path")
    s.add_argument("--target", required=True)
    s.add_argument("--formula", dest="text", required=True)
    y = sub.add_parser("symbols")
    y.add_argument("path")
    y.add_argument("--search")
    y.add_argument("--all", dest="everything", action="store_true")
    y.add_argument("--visible-only", action="store_true")
    n = sub.add_parser("resolve-symbols")
    n.add_argument("path")
    n.add_argument("--names", type=lambda x: tuple(x.split(",")), default=argparse.SUPPRESS)
    k = sub.add_parser("symbol-specs")
    k.add_argument("path")
    k.add_argument("--symbol")
    return top


COMMANDS = {"compare-feeds": experiments.compare_feeds, "discover": experiments.discover, "backtest": experiments.run_backtest, "multi-backtest": experiments.run_ensemble, "walk-forward": experiments.run_walk_forward, "robustness": experiments.run_robustness, "research": experiments.research, "symbols": experiments.search_symbols, "resolve-symbols": experiments.resolve_symbols, "symbol-specs": experiments.symbol_specs}


def main(argv: list[str] | None = None) -> str:
    given = vars(parser().parse_args(argv))
    command, folder = COMMANDS[given.pop("command")], given.pop("reports")
    path = write_report(command(get_session(), **given), folder)
    print(path)
    return path


if __name__ == "__main__":
    main()
