"""What the library offers: functions, reference tables and commands, with search over them."""

from __future__ import annotations

import inspect

from pyspark.sql import DataFrame, SparkSession

from glyphmill.functions import formatting, locales, matching, text
from glyphmill.operators import tables
from glyphmill.sources import catalogues, files

MODULES = {"text": text, "matching": matching, "formatting": formatting, "locales": locales, "tables": tables, "catalogues": catalogues, "files": files}


def features() -> list[tuple[str, str, str, str]]:
    """`(module, name, signature, doc)` of every public function."""
    out = []
    for name, module in MODULES.items():
        for f, value in vars(module).items():
            if inspect.isfunction(value) and value.__module__ == module.__name__ and not f.startswith("_"):
                out.append((name, f, str(inspect.signature(value)).replace("'", ""), (inspect.getdoc(value) or "").split("\n")[0]))
    return out


def features_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(features(), "module string, name string, signature string, doc string")


def search(query: str) -> list[tuple[str, str, str, str]]:
    """Features whose name or description holds the query; case does not matter."""
    q = query.lower()
    return [f for f in features() if q in f[1].lower() or q in f[3].lower()]


def commands() -> list[tuple[str, str, str]]:
    """`(command, subcommand, options)` of the command line."""
    from glyphmill import cli  # the command line uses this module

    every = cli.TEXT | cli.TABLES | cli.LINES
    return [(c, s, " ".join(f"--{o} {v!r}" if v else f"--{o}" for o, v in every[c, s][1].items())) for c, s in sorted(every)]


def commands_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(commands(), "command string, subcommand string, options string")


def feature(name: str) -> tuple[str, str, str, str] | None:
    """One feature by its name."""
    return next((f for f in features() if f[1] == name), None)


def report() -> str:
    """All functions by module, then all commands."""
    out = []
    for module in MODULES:
        out += [f"{module}:"] + [f"  {name}{signature}  {doc}".rstrip() for m, name, signature, doc in features() if m == module]
    return "\n".join([*out, "commands:"] + [f"  {c} {s} {o}".rstrip() for c, s, o in commands()])
