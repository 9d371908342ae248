"""Command line: ``spark-submit`` or ``python -m lexitally <run> ...``."""

from __future__ import annotations

import argparse

from lexitally.plans import runs
from lexitally.session import build_session, drop_staged, input_bytes, shuffle_partitions


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lexitally", description="Analyse a labelled collection of texts")
    top.add_argument("--input-gb", type=float, default=None, help="size of the input, to size the shuffles (default: measured)")
    sub = top.add_subparsers(dest="run", required=True)

    def add(name, *places, **flags):
        p = sub.add_parser(name, help=getattr(runs, name).__doc__)
        for place in places:
            p.add_argument(place)
        for flag, options in flags.items():
            p.add_argument("--" + flag.replace("_", "-"), **options)

    add("clean", "raw", "out")
    add("clean_new", "raw", "out", "checkpoint")
    add("describe", "corpus", "out", top_n={"type": int, "default": 20})
    add("rank", "corpus", "out", top_n={"type": int, "default": 30})
    add("contrast", "rankings", "out", carryover={"action": "store_true"})
    add("classify", "corpus", "out")
    add(
        "ingest_manifest",
        "manifest",
        "out",
        raw={"default": None},
        limit={"type": int, "default": None},
        overwrite={"action": "store_true"},
        dry_run={"action": "store_true"},
        model={"default": "small"},
    )
    return top


def main(argv: list[str] | None = None) -> None:
    args = vars(parser().parse_args(argv))
    name, size = args.pop("run"), args.pop("input_gb")
    if name == "ingest_manifest":
        args["skip_existing"] = not args.pop("overwrite")
        args["method"] = f"whisper:{args.pop('model')}"
    spark = build_session(expected_bytes=None if size is None else int(size * (1 << 30)))
    if size is None:  # never fewer than the session was given
        least = int(spark.conf.get("spark.sql.shuffle.partitions"))
        sized = shuffle_partitions(input_bytes(spark, next(args[k] for k in ("raw", "corpus", "rankings", "manifest") if args.get(k))))
        spark.conf.set("spark.sql.shuffle.partitions", max(least, sized if sized > 200 else least))
    try:
        result = getattr(runs, name)(spark, **args)
        if result is not None:
            result.show(50, truncate=False)
    finally:
        drop_staged(spark)


if __name__ == "__main__":
    main()
