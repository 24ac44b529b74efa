"""Command line: silt ANALYSIS [flags], silt schema, silt print-log-command."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
import tempfile

from silt.errors import SiltError
from silt.plans.describe import META, command_list, command_schema
from silt.plans.encoding import encode
from silt.plans.result import emit, run
from silt.registry import analyses
from silt.shared import is_local
from silt.sources.definitions import parse_layers, parse_teams, read_text
from silt.sources.gitlog import log_command, read_log


class _Parser(argparse.ArgumentParser):
    def error(self, message: str):
        code = "invalid_value" if "invalid" in message and "choice" not in message else "unknown_command" if "choice" in message else "missing_required_flag" if "required" in message else "unknown_flag"
        raise SiltError(code, message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="silt")
    sub = top.add_subparsers(dest="command", parser_class=_Parser)
    for a in analyses():
        p = sub.add_parser(a.name, aliases=list(a.aliases), help=a.summary)
        p.set_defaults(name=a.name)
        p.add_argument("--log", default="")
        p.add_argument("--rows", type=int, default=0)
        p.add_argument("--fields", default="")
        p.add_argument("--out", default="", help="a folder for the rows, which tasks write, and the envelope, in place of standard output")
        p.add_argument("--include", action="append", default=[])
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--group", default="")
        p.add_argument("--group-format", default="text")
        p.add_argument("--temporal-period", type=int, default=0)
        p.add_argument("--team-map", default="")
        p.add_argument("--team-map-format", default="csv")
        for f in a.flags:
            if f.type == "bool":
                p.add_argument(f"--{f.name}", action="store_true", default=f.default)
            else:
                p.add_argument(f"--{f.name}", type=int if f.type == "int" else str, default=f.default, required=f.required)
    for n, m in META.items():
        p = sub.add_parser(n, help=m["summary"])
        p.set_defaults(name=n)
        for f in m["flags"]:
            p.add_argument(f"--{f.name}", **({"action": "store_true"} if f.type == "bool" else {"default": f.default}), dest="of" if f.name == "command" else f.arg)
    return top


def main(argv: list[str] | None = None, spark=None, stdin=None, out=None, err=None) -> int:
    """Runs one command; returns the exit code."""
    out, err = out or sys.stdout, err or sys.stderr
    try:
        args = parser().parse_args(argv)
        if not args.command:
            raise SiltError("unknown_command", "no command is given")
        if args.name == "schema":
            print(encode(command_schema(args.of) if args.of else command_list()), file=out)
        elif args.name == "print-log-command":
            print(log_command(args.after, args.all), file=out)
        else:
            _analyse(args, spark, stdin or sys.stdin, out, err)
        return 0
    except SiltError as e:
        print(encode(e.envelope()), file=err)
        return e.exit_code
    except Exception as e:  # noqa: BLE001  whatever else goes wrong is reported in the same form
        print(encode(SiltError("internal_error", str(e)[:2000]).envelope()), file=err)
        return 70


def _analyse(args, spark, stdin, out, err) -> None:
    from silt.operators.transforms import Transforms

    spooled, piped = None, args.log in ("", "-")
    if not piped and "://" not in args.log and not os.path.isfile(args.log):
        raise SiltError("log_open_failed", f"{args.log} can't be opened", {"path": args.log})
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("silt").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
        spark.sparkContext.setLogLevel("ERROR")
    if piped:
        if not is_local(spark):
            raise SiltError("log_open_failed", "a cluster can't read this machine's standard input; pass --log with a path that it can read", {"path": args.log})
        with tempfile.NamedTemporaryFile("w", suffix=".log", delete=False, encoding="utf-8", errors="surrogateescape", newline="") as f:
            shutil.copyfileobj(stdin, f)
        spooled = args.log = f.name
    try:
        facts = read_log(spark, args.log if "://" in args.log else f"file://{os.path.abspath(args.log)}")
        a = next(x for x in analyses() if x.name == args.name)
        if args.temporal_period < 0:
            raise SiltError("invalid_temporal_period", "a period is positive", {"period": args.temporal_period})
        transforms = Transforms(
            args.include,
            args.exclude,
            parse_layers(read_text(args.group, "group"), args.group_format) if args.group else None,
            args.temporal_period,
            parse_teams(read_text(args.team_map, "team-map"), args.team_map_format) if args.team_map else None,
        )
        flags = {f.arg: getattr(args, f.arg) for f in a.flags}
        if args.out:
            r = emit(args.name, facts, args.out if "://" in args.out else f"file://{os.path.abspath(args.out)}", transforms, args.rows, args.fields, **flags)
        else:
            r = run(args.name, facts, transforms, args.rows, **flags)
        for w in r.warnings:
            print(encode(w), file=err)
        if not args.out:
            print(r.json(args.fields), file=out)
    finally:
        if spooled:
            os.unlink(spooled)


if __name__ == "__main__":
    sys.exit(main())
