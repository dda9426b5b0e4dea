"""Command line: ``python -m arborlens.cli --script-dir DIR --result-dir DIR --schema FILE [analyses]`` or ``... schema FILE``."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from arborlens.schema.idl import compile_idl


def _sizes(text: str) -> list[int]:
    sizes = [int(x) for x in str(text).split(",") if x]
    if not sizes:
        raise argparse.ArgumentTypeError("window sizes are whole numbers with commas between")
    return sizes


def arguments() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="arborlens", description="Statistics and entropy coding of corpora of typed trees.")
    p.add_argument("--script-dir", required=True, help="corpus: files *.js")
    p.add_argument("--result-dir", required=True, help="store of results; a new directory or one with its marker file")
    p.add_argument("--schema", required=True, help="interface definitions of the trees")
    p.add_argument("--string-window", action="store_true")
    p.add_argument("--string-window-sizes", type=_sizes, default=None, metavar="N,N")
    p.add_argument("--pretty-print", action="store_true")
    p.add_argument("--path-suffix", action="store_true")
    p.add_argument("--path-suffix-length", type=int, choices=range(4), default=1)
    p.add_argument("--global-strings", action="store_true")
    p.add_argument("--entropy-code", action="store_true")
    p.add_argument("--least-size", type=int, default=100_000, help="bytes from which a script is coded")
    p.add_argument("--trees", action="store_true", help="the files hold parser trees as JSON, not source text")
    p.add_argument("--compat", action="store_true", help="reproduce known slips, see the README")
    return p


def wanted(options: argparse.Namespace) -> dict[str, dict]:
    """Options of the chosen analyses by name."""
    out: dict[str, dict] = {}
    if options.string_window:
        out["string-window"] = {"sizes": options.string_window_sizes}
    if options.pretty_print:
        out["pretty-print"] = {}
    if options.path_suffix:
        out["path-suffix"] = {"length": options.path_suffix_length}
    if options.global_strings:
        out["global-strings"] = {"compat": options.compat}
    if options.entropy_code:
        out["entropy-code"] = {"least_size": options.least_size}
    return out


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if argv[:1] == ["schema"]:
        if len(argv) != 2:
            print("schema takes one file", file=sys.stderr)
            return 2
        print(compile_idl(Path(argv[1]).read_text()).describe(), end="")
        return 0
    options = arguments().parse_args(argv)

    from pyspark.sql import SparkSession

    from arborlens.plans.analyses import Corpus, analyze
    from arborlens.sources.store import Store

    spark = SparkSession.builder.getOrCreate()
    schema = compile_idl(Path(options.schema).read_text(), compat=options.compat)
    scripts, results = Store.open(spark, options.script_dir), Store.create(spark, options.result_dir)
    corpus = Corpus.read(spark, schema, scripts.texts(), compat=options.compat, **({"parser": None} if options.trees else {}))
    analyze(corpus, wanted(options), results)
    return 0


if __name__ == "__main__":
    sys.exit(main())
