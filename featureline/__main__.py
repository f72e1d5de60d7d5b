"""Command line of the jobs:  python -m featureline generate|check|materialize|train|score|score-catalog ..."""

from __future__ import annotations

import argparse
import logging
import sys
from datetime import datetime, timezone

from featureline.plans.publish import check, generate, materialize
from featureline.plans.score import ScoreConfig, score_catalog, score_job
from featureline.plans.train import TrainConfig, from_catalog, train_job
from featureline.schema import CUSTOMER_FEATURE_REFS
from featureline.session import build_session
from featureline.sources.catalog import Catalog

logger = logging.getLogger("featureline")


def parse(argv: list[str] | None = None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="featureline")
    jobs = parser.add_subparsers(dest="job", required=True)

    def job(name: str, **help_text: str) -> argparse.ArgumentParser:
        sub = jobs.add_parser(name)
        sub.add_argument("--base", required=True, help="folder with the offline tables")
        sub.add_argument("--now", type=datetime.fromisoformat, default=None, help="time of the run, for replays")
        for option, text in help_text.items():
            sub.add_argument(f"--{option.replace('_', '-')}", help=text)
        return sub

    job("generate").add_argument("--n-customers", type=int, default=200)
    job("check")
    job("materialize")
    train = job("train")
    train.add_argument("--registry", required=True)
    train.add_argument("--model-name", default="churn_model")
    train.add_argument("--catalog", help="take label, feature references and experiment from the model's catalog row")
    score = job("score", predictions="folder for predictions")
    score.add_argument("--registry", required=True)
    score.add_argument("--model-name", default="churn_model")
    score.add_argument("--feature-refs", default=",".join(CUSTOMER_FEATURE_REFS))
    score.add_argument("--catalog", help="take the feature references from the model's catalog row")
    score.add_argument("--output", choices=["class", "probability"], default="class")
    catalog = job("score-catalog", predictions="folder for predictions")
    catalog.add_argument("--registry", required=True)
    catalog.add_argument("--catalog", required=True)
    return parser.parse_args(argv)


def run(args: argparse.Namespace) -> None:
    spark = build_session()
    now = args.now or datetime.now(timezone.utc)
    if args.job == "generate":
        generate(spark, args.base, args.n_customers, now)
    elif args.job == "check":
        for report in check(spark, args.base):
            logger.info("%s", report.first().asDict())
    elif args.job == "materialize":
        logger.info("online rows: %d", materialize(spark, args.base, now).count())
    elif args.job == "train":
        cfg = TrainConfig(args.base, args.registry, args.model_name)
        if args.catalog:
            cfg = from_catalog(Catalog(spark, args.catalog).get(args.model_name).first(), cfg)
        logger.info("%s", train_job(spark, cfg, now))
    elif args.job == "score":
        refs = Catalog(spark, args.catalog).get(args.model_name).first()["feature_refs"] if args.catalog else args.feature_refs
        cfg = ScoreConfig(args.base, args.registry, args.model_name, refs,
                          predictions=args.predictions, output=args.output)
        logger.info("predictions in %s", score_job(spark, cfg, now))
    else:
        models = Catalog(spark, args.catalog).models()
        logger.info("predictions in %s", score_catalog(spark, models, args.base, args.registry, now,
                                                       predictions=args.predictions))


def main(argv: list[str] | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s: %(message)s")
    args = parse(argv)
    try:
        run(args)
    except Exception:
        logger.exception("%s failed", args.job)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
