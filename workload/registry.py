"""Where queries and their SQL are registered, and how inputs are derived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from whofor.session import spread_small
from workload.fixtures import FIXTURES, TABLES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` names the fixtures it needs as ``@fx_name``."""
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_fixtures(sql)
        return fn
    return keep


def needed(sql: str) -> list[str]:
    """Fixtures a text refers to, directly or through others, in definition order."""
    wanted, todo = set(), [sql]
    while todo:
        text = todo.pop()
        for name, body in FIXTURES.items():
            if name not in wanted and f"@{name}" in text:
                wanted.add(name)
                todo.append(body)
    return [n for n in FIXTURES if n in wanted]


def with_fixtures(sql: str) -> str:
    names = needed(sql)
    text = sql.strip()
    if names:
        ctes = ",\n".join(f"{n} as ({FIXTURES[n].strip()})" for n in names)
        lead = next((w for w in ("with recursive ", "with ") if text.lower().startswith(w)), "")
        text = f"{lead or 'with '}{ctes}{',' if lead else ''}\n{text[len(lead):]}"
    for n in FIXTURES:
        text = text.replace(f"@{n}", n)
    return text


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fixture(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """A derived input as a Spark query over the given tables."""
    return run_sql(spark, sf_dir, f"select * from @{name}", spread)


def run_sql(spark: SparkSession, sf_dir: str, sql: str, spread: bool = False) -> DataFrame:
    """``spread`` readies small tables for CPU-bound work (see ``spread_small``)."""
    text = with_fixtures(sql)
    for t in TABLES:
        if t in text:
            df = table(spark, sf_dir, t)
            (spread_small(df) if spread else df).createOrReplaceTempView(t)
    return spark.sql(text)
