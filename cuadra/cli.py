"""Command line: init, validate, run, explain."""

from __future__ import annotations

import argparse
import json
import logging
import sys
import traceback
from dataclasses import fields
from pathlib import Path

from pyspark.sql import SparkSession

from .config import Limits, load
from .errors import KIND_CODES, ReconError, classify
from .plans import run as plans


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="cuadra")
    parser.add_argument("--debug", action="store_true")
    parser.add_argument("--log-level", default="WARNING")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init").add_argument("--out-dir", type=Path, required=True)
    for name in ("validate", "run"):
        p = commands.add_parser(name)
        for flag in ("--config", "--bank", "--expected"):
            p.add_argument(flag, type=Path, required=True)
        p.add_argument("--enable-ocr", action="store_true")
        for f in fields(Limits):
            p.add_argument("--" + f.name.replace("_", "-"), type=int)
        if name == "run":
            p.add_argument("--out", type=Path, required=True)
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--mask", action=argparse.BooleanOptionalAction, default=None)
    p = commands.add_parser("explain")
    p.add_argument("--run-dir", type=Path, required=True)
    p.add_argument("id")
    return parser


def _spark(level: str) -> SparkSession:
    spark = SparkSession.builder.appName("cuadra").getOrCreate()
    set_log_level(level, spark)
    return spark


def set_log_level(level: str, spark: SparkSession | None = None) -> None:
    """The level of this package's loggers and of Spark's; an unknown one is INFO."""
    level = level.upper()
    logging.basicConfig(level=getattr(logging, level, logging.INFO), format="%(message)s")
    if spark is not None:
        spark.sparkContext.setLogLevel({"WARNING": "ERROR", "CRITICAL": "FATAL"}.get(level, level if level in ("DEBUG", "INFO", "ERROR") else "INFO"))


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    try:
        if args.command == "init":
            print("\n".join(plans.write_templates(args.out_dir)))
            return 0
        if args.command == "explain":
            print(json.dumps(plans.explain(args.run_dir, args.id), indent=2, ensure_ascii=False, sort_keys=True))
            return 0
        caps = {f.name: getattr(args, f.name) for f in fields(Limits)}
        if args.command == "validate":
            result = plans.validate(_spark(args.log_level), args.config, args.bank, args.expected, enable_ocr=args.enable_ocr, **caps)
            print(json.dumps(result, indent=2, ensure_ascii=False, sort_keys=True, default=str))
            return 0 if result["ok"] else KIND_CODES.get(result["error_type"], KIND_CODES["ingestion"])
        mask = load(args.config).mask_por_defecto if args.mask is None else args.mask
        document = plans.run(_spark(args.log_level), args.config, args.bank, args.expected, args.out, mask=mask, dry_run=args.dry_run, enable_ocr=args.enable_ocr, **caps)
        print(json.dumps({"run_id": document["run_id"], **{k: document.counts[k] for k in ("matches", "hallazgos")}}))
        return 0
    except Exception as error:
        category, code = classify(error)
        if args.command == "run":
            try:
                plans.AuditLog(args.out / "audit.jsonl", None).write("cli_error", "Ejecucion CLI fallida", {"command": args.command, "category": category, "exit_code": code, "error": str(error)})
            except OSError:
                pass
        print(f"[{category}] {error}", file=sys.stderr)
        if isinstance(error, ReconError):
            for k in sorted(error.details):
                print(f"  {k}: {error.details[k]}", file=sys.stderr)
            if error.hint:
                print(f"  {error.hint}", file=sys.stderr)
        if args.debug:
            traceback.print_exc()
        return code


if __name__ == "__main__":
    sys.exit(main())
