"""Run a registered query: ``python -m pulselake NAME FOLDER [--out PATH] [--explain]``."""

from __future__ import annotations

import argparse

from pulselake.plans import registry
from pulselake.session import get_session


def main(arguments: list[str] | None = None) -> None:
    known = registry.queries()
    parser = argparse.ArgumentParser(prog="pulselake")
    parser.add_argument("name", choices=sorted(known))
    parser.add_argument("folder", help="folder of the Parquet tables")
    parser.add_argument("--out", help="write the result there as Parquet instead of showing it")
    parser.add_argument("--explain", action="store_true", help="show the plan only")
    chosen = parser.parse_args(arguments)
    frame = known[chosen.name](get_session("pulselake"), chosen.folder)
    if chosen.explain:
        frame.explain("formatted")
    elif chosen.out:
        frame.write.mode("overwrite").parquet(chosen.out)
    else:
        frame.show(20, truncate=60)


if __name__ == "__main__":
    main()
