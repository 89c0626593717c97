"""Commands: ``extract`` for texts and ``audit`` for an archive; both print JSON."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence

import verbatlas
from verbatlas.operators.actions import ExtractionOptions, extraction_results
from verbatlas.session import get_session
from verbatlas.sources import sinks, texts


def parser() -> argparse.ArgumentParser:
    root = argparse.ArgumentParser(prog="verbatlas")
    root.add_argument("--version", action="version", version=verbatlas.__version__)
    commands = root.add_subparsers(dest="command", required=True)
    extract = commands.add_parser("extract", help="action frames of a text as JSON")
    extract.add_argument("text", nargs="*", help="words of the text; standard input if there are none")
    extract.add_argument("--input-file", help="a UTF-8 file instead of words")
    extract.add_argument("--config", help="a TOML file of options")
    extract.add_argument("--pretty", action="store_true", help="indented output")
    audit = commands.add_parser("audit", help="report on a layered archive as JSON")
    audit.add_argument("archive")
    audit.add_argument("--allow", action="append", default=[], help="an admitted document; repeatable")
    return root


def main(argv: Sequence[str] | None = None) -> int:
    root = parser()
    args = root.parse_args(argv)
    if args.command == "extract" and args.text and args.input_file:
        root.error("give a text or --input-file, not both")
    spark = get_session(2, 2)
    try:
        if args.command == "audit":
            from verbatlas.operators.audit import audit_archive

            print(sinks.report_json(audit_archive(spark, args.archive, args.allow, allow_unpinned=True)))
            return 0
        options = texts.options_from_toml(args.config) if args.config else ExtractionOptions()
        if args.input_file:
            with open(args.input_file, encoding="utf-8") as source:
                documents = texts.from_stream(spark, source)
        else:
            documents = texts.from_words(spark, args.text) if args.text else texts.from_stream(spark)
        row = sinks.result_json(extraction_results(documents, options)).first()
        print(json.dumps(json.loads(row.json), indent=2 if args.pretty else None, ensure_ascii=False))
        return 0
    except (OSError, ValueError, TypeError) as error:
        root.error(str(error))


if __name__ == "__main__":
    sys.exit(main())
