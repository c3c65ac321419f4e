"""Command line: anonymise an archive, compare two, or write a generated one. Exit code 2 if the verdict is not ok."""

from __future__ import annotations

import argparse
import json
import secrets
from pathlib import Path

from pyspark.sql import SparkSession

from maskwright.operators import allocate, rewrite, verify
from maskwright.plans import archives
from maskwright.session import session, ship
from maskwright.sources import archive, mock
from maskwright.store import written


def _mapping(spark: SparkSession, path: str):
    return allocate.read_sidecar(spark.read.text(path, wholetext=True))


def _verdict(before, after, mapping: dict, redacted: bool, report: str | None, names=None, checks=None) -> int:
    found = archives.verified(before, after, mapping, redacted, names).cache()
    summary = verify.summarise(found, checks).first().asDict()
    routing = [r.asDict() for r in archives.routing_coherence(before, after, names).collect()]
    print(json.dumps(summary | {"routing": routing}, indent=2))
    if report:
        found.write.mode("overwrite").json(report)
    found.unpersist()
    return 0 if summary["ok"] and not any(r["mismatches"] for r in routing) else 2


def _renamed(before, mapping: dict):
    """before under the names that the mapping gives, as the output should have them."""
    return rewrite.rewrite_members(before, rewrite.final_mapping(mapping), False)


def _pairs(spark: SparkSession, before, after):
    """Archives of either side in the order of their names; of two single ones, whatever they are called, the pair."""
    one, two = ([r[0] for r in side.select("archive").distinct().orderBy("archive").collect()] for side in (before, after))
    by_output = {Path(archive.output_name(a)).name: a for a in one}
    rows = [(one[0], two[0])] if len(one) == len(two) == 1 else [(by_output[Path(b).name], b) for b in two if Path(b).name in by_output]
    return spark.createDataFrame(rows, "before string, after string")


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="maskwright", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("anonymise")
    one.add_argument("input")
    one.add_argument("--output")
    one.add_argument("--seed-mapping", help="sidecar of an earlier run to go on from")
    one.add_argument("--words", help="file of plain words that are never identities")
    one.add_argument("--keep-free-text", action="store_true")
    one.add_argument("--redact-binaries", action="store_true")
    one.add_argument("--mapping-only", action="store_true")
    one.add_argument("--verify", action="store_true")
    one.add_argument("--report")
    two = commands.add_parser("compare")
    two.add_argument("original")
    two.add_argument("anonymised")
    two.add_argument("--mapping", required=True)
    two.add_argument("--report")
    made = commands.add_parser("mock")
    made.add_argument("output")
    made.add_argument("--lines", type=int, default=400)
    made.add_argument("--seed", type=int, default=7)
    args = parser.parse_args(argv)

    if args.command == "mock":
        Path(args.output).write_bytes(mock.archive(args.lines, args.seed))
        return 0
    spark = session()
    ship(spark)
    if args.command == "compare":
        sidecar = json.loads(Path(args.mapping).read_text())
        mapping = rewrite.collected(_mapping(spark, args.mapping))
        before, after = (archive.read_archives(spark, p) for p in (args.original, args.anonymised))
        names = _pairs(spark, before, after)
        checks = archives.archive_check(_renamed(before, mapping), after, names)
        return _verdict(before, after, mapping, bool(sidecar.get("redact_free_text")), args.report, names, checks)

    seed, previous = secrets.token_hex(16), None
    if args.seed_mapping:
        seed = json.loads(Path(args.seed_mapping).read_text()).get("ip_seed") or seed
        previous = _mapping(spark, args.seed_mapping)
    words = tuple(Path(args.words).read_text().split()) if args.words else ()
    before = archive.read_archives(spark, args.input)
    done = archives.anonymise(before, seed, previous, not args.keep_free_text, args.redact_binaries, words)
    several = Path(args.input).is_dir() or any(c in args.input for c in "*?[")
    output = args.output or (f"{args.input.rstrip('/*')}_anon" if several else archive.output_name(args.input))
    sidecar = allocate.as_sidecar(done.mapping, seed, not args.keep_free_text).first()["value"]
    Path(f"{output}.mapping.json" if several else archive.output_name(output, ".mapping.json")).write_text(json.dumps(json.loads(sidecar), indent=2, ensure_ascii=False))
    if args.mapping_only:
        return 0
    # Written once: the report and the archives are made from the same rewritten members.
    members = written(done.members, "rewritten")
    if several:
        archive.write_archives(members, output).collect()
    else:
        archive.write_archive(members, output)
    print(json.dumps(rewrite.outcome_summary(members).first().asDict(), indent=2))
    if not args.verify:
        return 0
    after = archive.read_archives(spark, output)  # what was written, not what was meant
    names = _pairs(spark, before, after)
    return _verdict(before, after, done.frozen, not args.keep_free_text, args.report, names, archives.archive_check(members, after, names))


if __name__ == "__main__":
    raise SystemExit(main())
