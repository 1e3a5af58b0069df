"""python -m tokenloom encode --vocab FILE [--input PATH --output PATH] | compile --vocab FILE --out FILE"""

from __future__ import annotations

import argparse
import sys

from .sources import sinks, texts, vocabularies
from .tokenizer import Tokenizer


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tokenloom")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("encode", help="ids of each line, separated by blanks")
    e.add_argument("--vocab", required=True)
    e.add_argument("--format")
    e.add_argument("--mode", default="adaptive")
    e.add_argument("--input", help="text files, read and written by Spark; else standard input")
    e.add_argument("--output")
    c = sub.add_parser("compile", help="a JSON vocabulary to the compiled form")
    c.add_argument("--vocab", required=True)
    c.add_argument("--out", required=True)
    a = p.parse_args(argv)
    if a.command == "compile":
        vocabularies.save(vocabularies.load(a.vocab, "hf_json"), a.out)
        return 0
    t = Tokenizer.load(a.vocab, a.format, a.mode)
    if a.input:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
        sinks.id_lines(t.transform(texts.lines(spark, a.input)), a.output)
        return 0
    for line in sys.stdin:
        print(*t.encode(line.removesuffix("\n").removesuffix("\r")))
    return 0


if __name__ == "__main__":
    sys.exit(main())
