"""Command line: ``spark-submit -m factloom.cli <command>``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from factloom import workflow
from factloom.operators import cards, merge, retrieval, service
from factloom.policy import load_policy
from factloom.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factloom")
    sub = p.add_subparsers(dest="command", required=True)

    def add(name: str, **help_) -> argparse.ArgumentParser:
        c = sub.add_parser(name, **help_)
        c.add_argument("--root", required=True, help="folder of the published versions")
        return c

    r = add("refresh", help="build a version from raw files and publish it when its gates pass")
    r.add_argument("--raw", required=True)
    r.add_argument("--run-id", required=True)
    r.add_argument("--run-number", type=int, required=True)
    r.add_argument("--observed-at", required=True)
    r.add_argument("--first", action="store_true", help="there is no earlier version")
    r.add_argument("--max-count-drop", type=float, default=0.25)
    r.add_argument("--max-missing", type=int, default=0)
    for name in ("search", "answer"):
        c = add(name)
        c.add_argument("question")
        c.add_argument("--mode", choices=("sparse", "dense", "hybrid"), default="sparse")
        c.add_argument("--top-k", type=int, default=5)
    card = add("card", help="evidence card of one entity")
    card.add_argument("entity_id")
    compare = add("compare", help="comparison of two to ten entities")
    compare.add_argument("entity_ids", nargs="+")
    for c in (card, compare, sub.choices["answer"]):
        c.add_argument("--now", required=True)
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = build_session("factloom")
    if args.command == "refresh":
        result = workflow.refresh(spark, args.raw, args.run_id, args.run_number, args.observed_at, previous=None if args.first else args.root,
                                  max_drop=args.max_count_drop, max_missing=args.max_missing)
        result.gates.show(100, truncate=False)
        if not result.passed:
            return 2
        print(workflow.publish(spark, args.root, args.run_id, result))
        return 0
    store = workflow.open_store(spark, args.root)
    policy = load_policy()
    if args.command in {"search", "answer"}:
        questions = spark.createDataFrame([("q", args.question)], "question_id string, question string")
        index = merge.read_current(spark, args.root, "index") if args.mode != "sparse" else None
        if args.command == "search":
            out = retrieval.search(args.mode, store.chunks, questions, index=index, top_k=args.top_k)
        else:
            out = service.answer_questions(questions, store, policy, F.to_timestamp(F.lit(args.now)), mode=args.mode, top_k=args.top_k, index=index)
        out.show(args.top_k, truncate=False)
        return 0
    subjects = store.catalogue.select(F.col("entity_id").alias("subject_id"))
    fields = cards.card_fields(subjects, store.facts, store.evidence, None, policy, cards.ENTITY_FIELDS, F.to_timestamp(F.lit(args.now)))
    if args.command == "card":
        fields.filter(F.col("subject_id") == args.entity_id).orderBy("field_order").show(20, truncate=False)
    else:
        cards.compare(fields, args.entity_ids).show(20, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
