"""python -m keyloom.engine.cli FOLDER [OPTIONS FILE]: a prompt for statements; ``use NAME``, ``autocommit on|off`` and ``exit`` besides."""

from __future__ import annotations

import sys
import time
from collections.abc import Iterable

from keyloom.engine.session import Result, Session
from keyloom.errors import KeyloomError


def cell(value: object) -> str:
    if value is None:
        return "N/A"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value:.2f}"
    return value.hex() if isinstance(value, (bytes, bytearray)) else str(value)


def table_text(columns: list[str], rows: Iterable, first: str | None = None) -> str:
    """Rows as a table of characters, the key column first, with their number below."""
    order = sorted(range(len(columns)), key=lambda i: columns[i] != first)
    lines = [[columns[i] for i in order], *[[cell(r[i]) for i in order] for r in rows]]
    widths = [max(len(x[i]) for x in lines) for i in range(len(columns))]
    bar = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    text = ["|" + "|".join(f" {v:<{w}} " for v, w in zip(x, widths, strict=True)) + "|" for x in lines]
    return "\n".join([bar, text[0], bar, *text[1:], *([bar] if len(text) > 1 else []), f"{len(text) - 1} rows in set"])


def result_text(result: Result, first: str | None = None) -> str:
    if result.kind == "data":
        return table_text(result.columns, result.data.toLocalIterator(), first)
    return f"Transaction {result.count} started" if result.kind == "transaction" else f"{result.count} rows affected"


def run_line(session: Session, line: str) -> str | None:
    """The answer to a line; None ends the prompt."""
    word, _, rest = line.strip().rstrip(";").partition(" ")
    if word.lower() == "exit":
        return None
    began = time.time()
    try:
        if word.lower() == "use":
            session.use(rest.strip())
            out = "Database changed"
        elif word.lower() == "autocommit":
            session.set_auto_commit({"on": True, "off": False}[rest.strip().lower()])
            out = f"Auto-commit {rest.strip().lower()}"
        else:
            out = result_text(session.sql(line))
    except KeyloomError as x:
        return f"Error {x.code}, {type(x).__name__}: {x}"
    except KeyError:
        return "autocommit on, or autocommit off"
    return f"{out} ({time.time() - began:.2f} s)"


def prompt(session: Session, lines: Iterable[str]) -> Iterable[str]:
    """The answers to lines, until ``exit`` or their end; then the session is closed."""
    for line in lines:
        if line.strip():
            answer = run_line(session, line)
            if answer is None:
                break
            yield answer
    session.close()


def main(folder: str, options: str | None = None) -> None:
    from pyspark.sql import SparkSession

    from keyloom.engine.session import Engine, Options

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session = Engine(spark, folder, Options.read(spark, options) if options else None).session()
    for answer in prompt(session, sys.stdin):
        print(answer, flush=True)


if __name__ == "__main__":
    main(*sys.argv[1:])
