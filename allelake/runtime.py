"""What a console run reports: wrapped text, progress, timers, the session's settings as JSON, errors of an index."""

from __future__ import annotations

import contextlib
import json
import logging
import math
import platform
import sqlite3
import textwrap
import time
from collections.abc import Iterator

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("allelake")


def wrap(text: str, column: int, start: int = 0, indent: int = 0) -> str:
    """``text`` broken at blanks so that no line passes ``column``; the first line begins at ``start``, others are indented."""
    if not 0 <= max(start, indent) < column:
        raise ValueError("lines must begin left of the column")
    return textwrap.fill(text, column, initial_indent=" " * start, subsequent_indent=" " * indent)[start:]


def progress_bar(width: int, progress: float) -> str:
    """A bar of ``width`` places; progress counts from 0 to 1, what is no number as 0."""
    done = 0 if math.isnan(progress) else int(min(1.0, max(0.0, progress)) * width)
    return "[" + ("*" * done).ljust(width) + "]"


def report(spark: SparkSession) -> str:
    """Versions, master, cores and settings of a session, as JSON."""
    context = spark.sparkContext
    settings = {k: v for k, v in sorted(context.getConf().getAll()) if k.startswith("spark.sql.") or k in ("spark.master", "spark.executor.memory", "spark.executor.cores", "spark.driver.memory")}
    return json.dumps({"python": platform.python_version(), "spark": pyspark.__version__, "master": context.master, "default_parallelism": context.defaultParallelism, "settings": settings}, sort_keys=True)


def index_error(error: sqlite3.Error, statement: str | None = None) -> str:
    """Message of an SQLite error: its name and text, and the statement, if given."""
    text = f"{getattr(error, 'sqlite_errorname', type(error).__name__)}: {error}"
    return text if statement is None else f'{text}, in statement "{statement}"'


@contextlib.contextmanager
def timed(what: str) -> Iterator[None]:
    """Log how long something took, even if it fails."""
    began = time.monotonic()
    try:
        yield
    finally:
        log.info("%s: %.3f s", what, time.monotonic() - began)


def profiled(variants: DataFrame, name: str = "reader") -> tuple[DataFrame, Observation]:
    """``variants`` (dosages) and counters of what is read of them: rows, values, missing values; ``get`` of the second
    gives them after an action. Counting takes no pass of its own."""
    seen = Observation(name)
    missing = F.size(F.filter("dosages", lambda d: d.isNull() | F.isnan(d)))
    return variants.observe(seen, F.count(F.lit(1)).alias("rows"), F.sum(F.size("dosages")).alias("values"), F.sum(missing).alias("missing")), seen
