"""Command line: evaluate, train, predict, calibrate, all, ensemble, score, compare over a data folder."""

from __future__ import annotations

import argparse
from dataclasses import replace

from tidemark import workflows
from tidemark.operators import models
from tidemark.session import session
from tidemark.sources import writers

COMMANDS = ("evaluate", "train", "predict", "calibrate", "all", "ensemble", "score", "compare")


def _seeds(text: str) -> tuple[int, ...]:
    found = tuple(int(s) for s in text.split(",") if s.strip())
    if not found:
        raise argparse.ArgumentTypeError("at least one seed is needed")
    return found


def _positive(text: str) -> int:
    n = int(text)
    if n < 1:
        raise argparse.ArgumentTypeError("must be 1 or more")
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        p = sub.add_parser(name)
        p.add_argument("--data", required=True)
        p.add_argument("--out", required=True)
        p.add_argument("--cutoff", default="2026-01-01")
        p.add_argument("--rounds", type=_positive, help="of boosting; each model's own where it is not given")
        if name in ("evaluate", "all", "ensemble", "score", "compare"):
            p.add_argument("--seeds", type=_seeds, default=(0, 17) if name in ("evaluate", "all") else (0, 1, 2))
            p.add_argument("--bootstrap", type=_positive, default=2000)
        if name == "predict":
            p.add_argument("--model", required=True)
        if name in ("score", "compare"):
            p.add_argument("--results", required=True, help="name=folder of chance tables, comma-separated")
        if name == "ensemble":
            p.add_argument("--components", default="parser_softmax=1")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    data = workflows.load(session(), args.data, args.cutoff)
    ranker = replace(models.RANKER, rounds=args.rounds) if args.rounds else models.RANKER
    if args.command in ("calibrate", "all"):
        workflows.calibrate(data, f"{args.out}/calibration")
    if args.command in ("evaluate", "all"):
        workflows.evaluate(data, args.seeds, ranker, f"{args.out}/evaluation", args.bootstrap)
    if args.command in ("train", "all"):
        workflows.train(data, f"{args.out}/model", ranker)
    if args.command in ("predict", "all"):
        workflows.predict(data, f"{args.out}/model" if args.command == "all" else args.model, args.out)
    if args.command in ("score", "compare"):
        folders = dict(f.split("=", 1) for f in args.results.split(","))
        if args.command == "score":
            for name, folder in folders.items():
                writers.write_report(f"{args.out}/{name}", f"Scores of {name}", workflows.score_directory(data, folder, args.seeds, args.bootstrap))
        else:
            workflows.compare(data, folders, args.out, args.seeds, args.bootstrap)
    if args.command == "ensemble":
        weights = {n: float(w) for n, w in (c.split("=") for c in args.components.split(","))}
        workflows.ensemble(data, workflows.Recipe(weights, args.seeds, rounds=args.rounds, bootstrap=args.bootstrap), args.out)


if __name__ == "__main__":
    main()
