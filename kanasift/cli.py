"""Command line: analyse text, build, print and describe dictionaries.

    python -m kanasift analyze [-m A|B|C] [-a] [-s] [-d] [-t | -ts] [-f] [--format NAME] [-r SETTINGS] [-p FOLDER] [-o FILE] [FILE ...]
    python -m kanasift build -o FOLDER -m MATRIX [-d DESCRIPTION] CSV ...
    python -m kanasift ubuild -o FOLDER -s SYSTEM [-d DESCRIPTION] CSV ...
    python -m kanasift dump|header FOLDER

Without settings the sample dictionary is used. Texts of one machine's size are meant here; engine.py is for clusters.
"""

from __future__ import annotations

import argparse
import sys
from datetime import datetime, timezone

from .operators import analyze as core
from .operators.formats import formatter
from .plans.config import Anchor, Settings, assemble, dictionaries, is_file, load_dictionary, read_bytes
from .plans.progress import Progress, statistics
from .sources import binary, definitions, lexicon


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def _parts(args):
    from . import sample

    if not args.settings and not args.system:
        return sample.parts()
    anchor = Anchor([args.folder] if args.folder else [])
    settings = Settings.from_file(args.settings, anchor) if args.settings else Settings(sample.SETTINGS, anchor)
    more = {k: v for k, v in (("systemDict", args.system), ("userDict", args.user or None)) if v}
    settings = Settings(more, anchor).with_fallback(settings)
    return assemble(settings, *dictionaries(_session(), settings))


def lines_of(parts, line: str, mode: str, details: bool = False, wakati: bool = False, one_line: bool = False, style=None) -> list[str]:
    """What one input line gives: its sentences in a format, a line a token and EOS unless told; one_line joins them."""
    made = formatter(style or ("wakati" if wakati else "detailed" if details else "tabular"))
    found = [made(s.tokens(mode)) for s in core.sentences(parts, line)]
    return [" ".join(found)] if one_line and wakati else [x for text in found for x in text.split("\n")]


def _analyze(args) -> int:
    parts = _parts(args)
    out = open(args.output, "w", encoding="utf-8") if args.output else sys.stdout  # noqa: SIM115
    try:
        for name in args.files or ["-"]:
            with sys.stdin if name == "-" else open(name, encoding="utf-8") as f:
                for n, line in enumerate(f, 1):
                    try:
                        line = line.rstrip("\r\n")
                        if args.debug:
                            print("\n".join(core.lattice_text(parts, line)), file=out)
                        for x in lines_of(parts, line, args.mode, args.all, args.t or args.ts, args.t, args.format):
                            print(x, file=out)
                    except Exception as e:
                        if not args.ignore_errors:
                            raise
                        print(f"{name}:{n}: {e}", file=sys.stderr)
    finally:
        if out is not sys.stdout:
            out.close()
    return 0


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="kanasift", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    a = sub.add_parser("analyze")
    a.add_argument("-r", dest="settings")
    a.add_argument("-s", "--systemDict", dest="system")
    a.add_argument("--userDict", dest="user", action="append")
    a.add_argument("-p", dest="folder")
    a.add_argument("-m", dest="mode", choices=core.MODES, default="C")
    a.add_argument("-o", dest="output")
    a.add_argument("-a", dest="all", action="store_true")
    a.add_argument("-d", dest="debug", action="store_true")
    a.add_argument("-f", dest="ignore_errors", action="store_true")
    a.add_argument("-t", action="store_true")
    a.add_argument("-ts", action="store_true")
    a.add_argument("--format", help="tabular, detailed, wakati, or module:function of tokens")
    a.add_argument("files", nargs="*")
    for name in ("build", "ubuild"):
        b = sub.add_parser(name)
        b.add_argument("-o", dest="output", required=True)
        b.add_argument("-m" if name == "build" else "-s", dest="base", required=True)
        b.add_argument("-d", dest="description", default="")
        b.add_argument("files", nargs="+")
    for name in ("dump", "header"):
        sub.add_parser(name).add_argument("path")
    args = top.parse_args(argv)
    if args.command == "analyze":
        return _analyze(args)
    spark = _session()
    if args.command in ("build", "ubuild"):
        progress = Progress(lambda stage, n, seconds: print(f"{stage}: {n} in {seconds:.1f} s", file=sys.stderr))
        texts = [progress.step("read", lambda f=f: _read(f), len) for f in args.files]
        if args.command == "build":
            d = progress.step("build", lambda: lexicon.build_system(texts, definitions.read_matrix(_read(args.base)), args.description), lambda d: len(d.words))
        else:
            d = progress.step("build", lambda: lexicon.build_user(load_dictionary(spark, args.base), texts, args.description), lambda d: len(d.words))
        progress.step("write", lambda: lexicon.save(spark, d, args.output), lambda _: len(d.words))
        for name, n in statistics(d).items():
            print(f"{name}: {n}", file=sys.stderr)
    elif args.command == "dump":
        print("\n".join(lexicon.dump(load_dictionary(spark, args.path))))
    else:
        try:
            user, created, description = _header(spark, args.path)
        except Exception:
            print(f"{args.path}: invalid dictionary")
            return 1
        print(f"filename: {args.path}\ntype: {'user' if user else 'system'} dictionary\ncreateTime: {created.isoformat()}\ndescription: {description}")
    return 0


def _header(spark, path: str) -> tuple[bool, datetime, str]:
    """Whether a dictionary is a user's, when it was made, and its description: of a folder of tables or a binary file."""
    if is_file(path):
        head = binary.header(read_bytes(path))
        return head["is_user"], datetime.fromtimestamp(head["created"], timezone.utc), head["description"]
    m = spark.read.parquet(f"{path}/dict_meta").first()
    return m["is_user"], m["created"], m["description"]
