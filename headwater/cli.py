"""Command line: ``rehead``, restore the heading levels of one markdown file."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path

from headwater.functions.scanner import scan
from headwater.functions.tokens import tokenizer
from headwater.functions.markdown import strip_text
from headwater.operators.predict import HeuristicPredictor, LevelPredictor, RemotePredictor

SUFFIXES = (".md", ".markdown")


def rehead_text(text: str, predictor: LevelPredictor) -> str:
    """The text with predicted levels; texts without headings stay as they are."""
    spans = scan(text)
    if not spans:
        return text
    levels = predictor.predict([s.text for s in spans], strip_text(text, spans, 128, 128, tokenizer("piece")))
    levels = [*levels[: len(spans)], *(s.level for s in spans[len(levels) :])]
    return write_levels(text, spans, levels)


def write_levels(text: str, spans: list, levels: list[int]) -> str:
    """Each heading as an ATX heading of its new level; markers of quotes and lists stay before it."""
    import re

    lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
    for s, level in sorted(zip(spans, levels), reverse=True):
        lead = re.match(r"(?:[ \t]*(?:>|[-+*](?=[ \t])|\d{1,9}[.)](?=[ \t]))[ \t]*)*", lines[s.line_start])[0] if s.nested else ""
        lines[s.line_start : s.line_end] = [lead + "#" * level + " " + re.sub(r"[ \t]*\n[ \t]*", " ", s.text)]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rehead", description="Restore heading levels of a markdown file.")
    parser.add_argument("--input", "-i", required=True, type=Path)
    parser.add_argument("--output", "-o", type=Path, help="default: standard output")
    parser.add_argument("--model", "-m", default="heading-levels", help="model name of the endpoint")
    parser.add_argument("--endpoint", help="base URL of a chat-completions endpoint; without it the heuristic predicts")
    parser.add_argument("--api-key", default=os.environ.get("HEADWATER_API_KEY"))
    parser.add_argument("--gpu", action="store_true")
    parser.add_argument("--cpu", action="store_true")
    parser.add_argument("--force", "-f", action="store_true")
    argv = sys.argv[1:] if argv is None else argv
    args = parser.parse_args(argv)
    wrong = None
    if not args.input.exists():
        wrong = f"no such file: {args.input}"
    elif not args.input.is_file():
        wrong = f"not a file: {args.input}"
    elif args.input.suffix.lower() not in SUFFIXES:
        wrong = f"not a .md or .markdown file: {args.input}"
    elif args.output is not None and args.output.exists() and not args.force:
        wrong = f"{args.output} exists; --force overwrites it"
    if wrong:
        print(f"Error: {wrong}", file=sys.stderr)
        return 1
    if args.endpoint is None and any(a.split("=")[0] == "--api-key" for a in argv):
        wrong = "--api-key needs --endpoint"
    elif args.endpoint is not None and (args.gpu or args.cpu):
        wrong = "--gpu and --cpu don't go with --endpoint"
    elif args.gpu and args.cpu:
        wrong = "--gpu and --cpu exclude each other"
    if wrong:
        print(f"Error: {wrong}", file=sys.stderr)
        return 2
    predictor = RemotePredictor(args.endpoint, args.model, args.api_key) if args.endpoint else HeuristicPredictor()
    result = rehead_text(args.input.read_text(encoding="utf-8"), predictor)
    if args.output is None:
        sys.stdout.write(result if result.endswith("\n") else result + "\n")
        return 0
    args.output.parent.mkdir(parents=True, exist_ok=True)
    args.output.write_text(result, encoding="utf-8")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
