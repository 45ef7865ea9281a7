"""Command line: python -m marginalia --vault FOLDER COMMAND."""

from __future__ import annotations

import argparse
import difflib
import os

from .plans.pipeline import COMMAND_MAX_FREQUENCY, Notebook
from .plans.store import Store
from .session import builder
from .plans.tools import SnapshotTools, read_edits
from .sources.model import ChatClient

#: Notes, or pairs of them, that are asked about between two commits.
MODEL_BATCH = 16


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="marginalia")
    out.add_argument("--vault", required=True)
    out.add_argument("--state", help="folder of the state tables; .marginalia in the vault by default")
    out.add_argument("--model", help="ask this model; without it, words and shared tags decide")
    out.add_argument("--model-url", default="http://localhost:11434")
    out.add_argument("-v", "--verbose", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run")
    run.add_argument("--force", action="store_true")
    discover = commands.add_parser("discover-links")
    discover.add_argument("--min-tags", type=int, default=2)
    discover.add_argument("--max-tag-freq", type=int, default=COMMAND_MAX_FREQUENCY)
    discover.add_argument("--force", action="store_true")
    for one in (run, discover):
        one.add_argument("--think", action=argparse.BooleanOptionalAction, default=False)
    commands.add_parser("validate").add_argument("--fix", action="store_true")
    normalize = commands.add_parser("normalize-tags")
    normalize.add_argument("--apply", action="store_true")
    normalize.add_argument("--threshold", type=int, default=2)
    for name in ("apply-tags", "apply-links", "apply-edits"):
        commands.add_parser(name).add_argument("-y", "--yes", action="store_true")
    for name in ("status", "proposals", "clean-links", "daily"):
        commands.add_parser(name)
    for name in ("import-state", "export-state"):
        commands.add_parser(name).add_argument("file", help="a state file of JSON")
    return out


def listed(table) -> None:
    """All rows, a line each, without holding them together."""
    for row in table.toLocalIterator():
        print("  ".join(str(x) for x in row if x is not None))


def asked(edits) -> bool:
    """Shows what each note would become, and asks."""
    for row in edits.toLocalIterator():
        old, new = ((row[k] or "").splitlines() for k in ("old_content", "new_content"))
        print(*difflib.unified_diff(old, new, row["path"], row["path"], n=1, lineterm=""), sep="\n")
    return input("Proceed? [y/N] ").strip().lower() in ("y", "yes")


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    if not os.path.isdir(a.vault):
        raise SystemExit(f"{a.vault} is not a folder")
    spark = builder().getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    book = Notebook(spark, a.vault, Store(spark, a.state or os.path.join(os.path.abspath(a.vault), ".marginalia")))
    if a.model:
        tools = SnapshotTools.write(book.notes(), book.edits_folder) if a.command in ("run", "daily") else None
        book.enricher = book.verifier = ChatClient(a.model_url, a.model, getattr(a, "think", False), tools, a.verbose)
        book.batch_notes = book.batch_pairs = MODEL_BATCH
    match a.command:
        case "run":
            print(book.run(a.force))
        case "discover-links":
            print(book.discover(a.min_tags, a.max_tag_freq, a.force))
        case "validate":
            print(book.validate(a.fix, listed).first().asDict())
        case "normalize-tags":
            listed(book.normalize(a.apply, a.threshold))
        case "apply-tags":
            print(book.apply_tags(None if a.yes else asked))
        case "apply-links":
            print(book.apply_links(None if a.yes else asked))
        case "apply-edits":
            print(book.apply_edits(None if a.yes else asked))
        case "proposals":
            for table in book.proposals():
                listed(table)
        case "status":
            print(book.status())
        case "clean-links":
            print(book.clean())
        case "daily":
            print(book.daily())
        case "import-state":
            print(book.import_json(a.file))
        case "export-state":
            book.export_json(a.file)
    if a.model and book.enricher.tools:
        planned = read_edits(spark, book.edits_folder).count()
        if planned:
            print(f"{planned} edits planned by the model: apply-edits shows and writes them")


if __name__ == "__main__":
    main()
