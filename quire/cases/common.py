"""How cases are made: an option for each event, the same for Spark and for SQL, and the registration of queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.session import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def quoted(x: str | None) -> str:
    """A string as a SQL literal."""
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


class Options:
    """Texts of which each event has one, by its number, with the number modulo 7 behind a space if `numbered`."""

    def __init__(self, *texts: str | None, numbered: bool = False):
        self.texts, self.numbered = texts, numbered

    def rows(self, spark, sf_dir):
        """`event_id`, `text`."""
        of = F.element_at(F.array(*map(F.lit, self.texts)), (F.col("event_id") % len(self.texts) + 1).cast("int"))
        if self.numbered:
            of = F.concat(of, F.lit(" "), (F.col("event_id") % 7).cast("string"))
        return table(spark, sf_dir, "events", fine=True).select("event_id", of.alias("text"))

    def sql(self, name: str = "t") -> str:
        """The same as a common table expression."""
        tail = " || ' ' || (event_id % 7)" if self.numbered else ""
        return f"{name} AS (SELECT event_id, [{', '.join(map(quoted, self.texts))}][event_id % {len(self.texts)} + 1]{tail} AS text FROM events)"
