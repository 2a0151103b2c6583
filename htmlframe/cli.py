"""python -m htmlframe.cli [options] FILE|-: one document from the command line, without Spark."""

from __future__ import annotations

import argparse
import sys

from htmlframe import __version__
from htmlframe.functions import builder, encodings
from htmlframe.functions import selectors as sel
from htmlframe.operators.parse import render


def _flag(text: str) -> bool:
    return text.lower() not in ("false", "0", "f")


def run(args: list[str], stdin=None, stdout=None) -> int:
    p = argparse.ArgumentParser(prog="htmlframe", description="Parse and query HTML documents.")
    p.add_argument("-s", "--selector", default="", help="CSS selector to filter output")
    p.add_argument("-f", "--format", default="html", choices=("html", "text", "markdown"))
    p.add_argument("--first", action="store_true", help="only the first match")
    p.add_argument("--separator", default=" ", help="accepted, without effect")
    for name in ("strip", "pretty"):
        p.add_argument(f"--{name}", nargs="?", type=_flag, const=True, default=True)
    p.add_argument("--indent", type=int, default=2)
    p.add_argument("-v", "--version", action="version", version=f"htmlframe version {__version__}")
    p.add_argument("file", help="HTML file, or - for standard input")
    o = p.parse_args(args)
    if o.file == "-":
        data = (stdin or sys.stdin.buffer).read()
    else:
        with open(o.file, "rb") as f:
            data = f.read()
    doc = builder.parse(encodings.decode(data)[0])
    try:
        nodes = sel.select(doc, o.selector, first=o.first) if o.selector else [doc]
    except sel.SelectorError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    how = {"html": f"pretty{o.indent}" if o.pretty else "html", "text": "strip" if o.strip else "text", "markdown": "cli_markdown"}[o.format]
    text = "\n".join(r for r in (render(n, how) for n in nodes) if r)
    (stdout or sys.stdout).write(text + "\n" if text and not text.endswith("\n") else text)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
