"""The list of known names."""

from __future__ import annotations

import csv
from importlib import resources

from pyspark.sql import DataFrame, SparkSession


def load_names(path: str | None = None) -> dict[str, tuple[str, ...]]:
    """The bundled names, or those of a CSV file with the columns kind, kanji, katakana and romaji; none if there is no file."""
    try:
        text = resources.files("mailsieve.resources").joinpath("names.csv").read_text("utf-8") if path is None else open(path, encoding="utf-8").read()
    except (FileNotFoundError, TypeError):
        text = "kind,kanji,katakana,romaji\n"
    rows = list(csv.DictReader(text.splitlines()))
    of = lambda column, *kinds: tuple(dict.fromkeys(r[column] for r in rows if r["kind"] in kinds and r[column]))
    return {"last": of("kanji", "last"), "first": of("kanji", "first"), "katakana": of("katakana", "last", "first"), "romaji": of("romaji", "last", "first")}


def names_frame(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The names as a table of ``kind`` and ``name``, to be joined where there are too many for a pattern."""
    return spark.createDataFrame([(kind, name) for kind, found in load_names(path).items() for name in found], "kind string, name string")
