"""A shell: python -m quernel.shell [PATH]. Statements end with a semicolon; .analyze, .compact, .check, .dump and .quit are commands."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from quernel.errors import EngineError
from quernel.operators import checks
from quernel.plans.parser import split_script
from quernel.session import Database


def command(db: Database, line: str) -> str:
    match line.split()[0]:
        case ".analyze":
            return "\n".join(f"{n}: {s.rows} rows" for n, s in db.analyze(*line.split()[1:]).items())
        case ".compact":
            return f"{db.compact()} folders deleted"
        case ".dump":
            return db.dump_sql()
        case ".check":
            found = {}
            for name, t in db.state().tables.items():
                df = db.table(name)
                found |= {f"{name}.{c.name} not null": checks.nulls(df, c.name) for c in t.defs() if c.not_null}
                found |= {f"{name}.{c.name} size": checks.too_long(df, c.name, c.size) for c in t.defs() if c.size is not None}
            return "\n".join(f"{r['rule']}: {r['broken']}" for r in checks.report(found).collect()) if found else "nothing to check"
    return f"unknown command {line}"


def main() -> None:
    spark = SparkSession.builder.appName("quernel").getOrCreate()
    db, text = Database(spark, sys.argv[1] if len(sys.argv) > 1 else None), ""
    for line in sys.stdin:
        if not text and line.startswith("."):
            if line.strip() == ".quit":
                return
            print(command(db, line.strip()))
            continue
        text += line
        if not line.rstrip().endswith(";"):
            continue
        try:
            for statement in split_script(text):
                out = db.execute(statement)
                out.show(truncate=False) if out is not None else print("ok")
        except EngineError as e:
            print(f"error: {e}")
        text = ""


if __name__ == "__main__":
    main()
