"""A prompt over the SQL front end: python -m tessera PATH [USER [DATABASE]]. Statements end in a semicolon.

python -m tessera PATH --dump FOLDER [--schema-only] [--data-only] [--binary], and --restore FOLDER [--dry-run], in place
of the prompt, write and read dumps; -c 'STATEMENTS' runs statements.
"""

from __future__ import annotations

import argparse
import getpass
import sys

from pyspark.sql import SparkSession

from tessera import security
from tessera.engine import Engine
from tessera.errors import EngineError

HELP = r"""\q leave   \? this   \dt tables   \du users   \l databases   a statement ends in ;"""


def run(db: Engine, lines, show=print) -> None:
    """Read lines until they end or \\q comes; show each statement's rows, message or error."""
    held = ""
    for line in lines:
        word = line.strip()
        if not held and word in ("\\q", "\\?"):
            if word == "\\q":
                return
            show(HELP)
            continue
        held += line if line.endswith("\n") else line + "\n"
        if not held.strip():
            held = ""
        elif word.endswith(";") and held.count("'") % 2 == 0 or held.lstrip().startswith("\\"):
            text, held = held, ""
            try:
                out = db.sql(text)
                show(out if isinstance(out, str) else out._show_string(1000, False))
            except EngineError as e:
                show(f"{type(e).__name__}: {e}")
            except Exception as e:  # noqa: BLE001  Spark's own errors end the statement, not the session
                show(f"{type(e).__name__}: {str(e).splitlines()[0]}")


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("path")
    p.add_argument("user", nargs="?", default=security.ADMIN)
    p.add_argument("database", nargs="?", default=security.MAIN)
    p.add_argument("-c", "--command")
    p.add_argument("--dump")
    p.add_argument("--restore")
    for flag in ("schema-only", "data-only", "binary", "dry-run"):
        p.add_argument(f"--{flag}", action="store_true")
    return p.parse_args(args)


def work(db: Engine, a: argparse.Namespace, lines, show=print) -> None:
    if a.dump:
        show(db.dump(a.dump, a.schema_only, a.data_only, a.binary))
    elif a.restore:
        show(db.restore(a.restore, a.dry_run))
    else:
        run(db, [a.command + ";"] if a.command else lines, show)


def main() -> None:
    a = arguments(sys.argv[1:])
    password = getpass.getpass() if a.user != security.ADMIN else None
    work(Engine(SparkSession.builder.getOrCreate(), a.path, a.user, password, a.database), a, sys.stdin)


if __name__ == "__main__":
    main()
