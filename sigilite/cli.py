"""Command line: ``python -m sigilite scan|rules|pre-commit``.

Exit codes: 0 clean, 1 findings at least as severe as --fail-on, 2 wrong usage or a failing Git."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from sigilite import __version__
from sigilite.catalog import RULES, SEVERITIES, Config
from sigilite.operators.reports import NEVER, baseline_entries
from sigilite.session import get_spark
from sigilite.sinks import documents as D
from sigilite.sinks.rows import sarif_results
from sigilite.sources.git import GitError, coverage_warnings, head, read_history, read_staged
from sigilite.sources.tree import read_tree


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sigilite")
    p.add_argument("--version", "-V", action="version", version=__version__)
    sub = p.add_subparsers(dest="command", required=True)
    s = sub.add_parser("scan")
    s.add_argument("targets", nargs="*", default=["."])
    s.add_argument("--format", "-f", action="append", choices=["console", "json", "sarif"])
    s.add_argument("--output", "-o")
    s.add_argument("--git-history", action="store_true")
    s.add_argument("--allow-shallow", action="store_true")
    s.add_argument("--update-baseline", metavar="FILE")
    s.add_argument("--include-tests", action="store_true", help="don't lower the severity of findings in tests")
    s.add_argument("--scan-lockfiles", action="store_true")
    s.add_argument("--max-file-size", type=int, default=Config.max_file_size)
    s.add_argument("--max-line-length", type=int, default=Config.max_line_length)
    c = sub.add_parser("pre-commit")
    sub.add_parser("rules")
    for q in (s, c):
        q.add_argument("--baseline")
        q.add_argument("--fail-on", choices=[*SEVERITIES, "none"], default="medium")
        q.add_argument("--no-entropy", action="store_true")
        for name in ("--only", "--skip", "--skip-category"):
            q.add_argument(name, action="append", default=[])
    return p


def _config(a: argparse.Namespace) -> Config:
    many = lambda values: frozenset(x.strip() for v in values for x in v.split(",") if x.strip())
    scan = a.command == "scan"
    return Config(
        use_entropy=not a.no_entropy, only=many(a.only), skip=many(a.skip), skip_categories=many(a.skip_category),
        **({"demote_tests": not a.include_tests, "scan_noise_files": a.scan_lockfiles, "max_file_size": a.max_file_size, "max_line_length": a.max_line_length} if scan else {}),
    )


def main(argv: list[str] | None = None, spark=None, out=sys.stdout, err=sys.stderr) -> int:
    try:
        a = _parser().parse_args(argv)
    except SystemExit as e:
        return int(e.code or 0)
    fail = lambda text: print(text, file=err) or 2
    if a.command == "rules":
        out.write(D.rules_table(spark or get_spark(cores=2)))
        return 0
    config = _config(a)
    if config.unknown:
        known = ", ".join([r.id for r in RULES] + sorted({r.category for r in RULES}))
        return fail(f"unknown: {', '.join(config.unknown)}; known: {known}")
    forms = (getattr(a, "format", None) or ["console"]) if a.command == "scan" else ["console"]
    if getattr(a, "output", None) and len([f for f in forms if f != "console"]) != 1:
        return fail("--output needs exactly one format that is written to a file")
    targets = a.targets if a.command == "scan" else ["."]
    missing = [t for t in targets if not os.path.exists(t)]
    if missing:
        return fail(f"no such path: {', '.join(missing)}")
    spark = spark or get_spark(cores=1 if a.command == "pre-commit" else None)
    started, warnings = time.perf_counter(), []
    history = a.command == "scan" and a.git_history
    try:
        if a.command == "pre-commit":
            units = read_staged(spark, targets[0], config)
        elif history:
            units = read_history(spark, targets[0], config, a.allow_shallow)
            warnings = coverage_warnings(targets[0])
        else:
            units = read_tree(spark, targets, config)
        accepted = D.read_baseline(spark, a.baseline) if a.baseline and os.path.exists(a.baseline) else None
        frame, counts = D.run(units, config, accepted if not getattr(a, "update_baseline", None) else None, history)
        if getattr(a, "update_baseline", None):
            # the order of reports with the place in the line as the last word
            entries = [r.asDict() for r in baseline_entries(frame, "unit_seq").collect()]
            with open(a.update_baseline, "w", encoding="utf-8") as f:
                json.dump(D.baseline_document(entries), f, indent=2, ensure_ascii=False)
            return 0
        # a report on a terminal or in one file is as long as a person reads; rows go through write_rows
        found = [r.asDict() for r in frame.collect()]
        result = D.Result(found, counts["units"], counts["skipped"], counts["placeholders"], round(time.perf_counter() - started, 4), warnings, counts["suppressed"])
        commit = head(targets[0]) if os.path.isdir(targets[0]) else None
        for form in forms:
            if form == "console":
                if a.command == "scan" or found:
                    out.write(D.console(result))
                else:
                    out.write("nothing found in what is staged\n")
                continue
            document = D.json_document(result, commit) if form == "json" else D.sarif_document(result, [json.loads(r.json) for r in sarif_results(frame).collect()], commit)
            text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
            if a.output:
                with open(a.output, "w", encoding="utf-8") as f:
                    f.write(text)
            else:
                out.write(text)
    except (GitError, ValueError) as e:
        return fail(str(e))
    least = NEVER if a.fail_on == "none" else SEVERITIES.index(a.fail_on)
    return int(result.max_rank() >= least)


if __name__ == "__main__":
    sys.exit(main())
