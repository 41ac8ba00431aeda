"""The command line: a store below a folder."""

from __future__ import annotations

import argparse
import json
import sys

from evigrain.functions import fixed


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="evigrain", description="Retrieval of evidence under a token budget, on Spark")
    p.add_argument("--root", default=".")
    p.add_argument("--master")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("init")
    ingest = sub.add_parser("ingest")
    ingest.add_argument("adapter", choices=("docs", "jsonl", "graph"))
    ingest.add_argument("path")
    query = sub.add_parser("query")
    query.add_argument("query")
    query.add_argument("--budget", type=int, default=fixed.DEFAULT_BUDGET)
    query.add_argument("--json", action="store_true")
    feedback = sub.add_parser("feedback")
    feedback.add_argument("run_id")
    way = feedback.add_mutually_exclusive_group(required=True)
    way.add_argument("--accepted", action="store_true")
    way.add_argument("--rejected", action="store_true")
    feedback.add_argument("--reason", default="explicit user feedback")
    suppress = sub.add_parser("suppress")
    suppress.add_argument("unit_id")
    suppress.add_argument("--undo", action="store_true")
    suppress.add_argument("--reason", default="")
    audit = sub.add_parser("audit")
    audit.add_argument("target", help="a run, or verify")
    replay = sub.add_parser("replay")
    replay.add_argument("--to", help="an event by id or number")
    sub.add_parser("status")
    return p


def run(args, store):
    rows = lambda df: [r.asDict(True) for r in df.collect()]
    match args.command:
        case "init":
            return {"initialized": store.initialize()}
        case "ingest":
            return {"docs": store.ingest_documents, "jsonl": store.ingest_records, "graph": store.ingest_graph}[args.adapter](args.path)
        case "query":
            one = store.spark.createDataFrame([("q", args.query, args.budget)], "question_id string, query string, budget int")
            r = rows(store.query(one))[0]
            if args.json:
                return r | {"transcript": json.loads(r["transcript"]), "metrics": json.loads(r["metrics"])}
            return f"{r['context']}\n\n[AUDIT run={r['run_id']} tokens={r['context_tokens']}/{r['budget']}]"
        case "feedback":
            return {"events": store.feedback(args.run_id, args.accepted, args.reason)}
        case "suppress":
            store.suppress(args.unit_id, not args.undo, args.reason)
            return {"unit": args.unit_id, "suppressed": not args.undo}
        case "audit":
            if args.target == "verify":
                errors = rows(store.verify())
                return {"valid": not errors, "errors": errors}
            r = store.explain(args.target)
            return r | {"transcript": json.loads(r["transcript"]), "metrics": json.loads(r["metrics"])}
        case "replay":
            return {"marks": rows(store.replay(int(args.to) if args.to and args.to.isdigit() else args.to))}
        case "status":
            return store.status()


def main(argv: list[str] | None = None) -> int:
    from evigrain.api import Store
    from evigrain.session import build_session

    p = parser()
    args = p.parse_args(argv)
    try:
        out = run(args, Store(build_session(master=args.master), args.root))
    except (FileNotFoundError, KeyError, ValueError) as e:
        p.exit(2, f"evigrain: {e}\n")
    print(out if isinstance(out, str) else json.dumps(out, ensure_ascii=False, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
