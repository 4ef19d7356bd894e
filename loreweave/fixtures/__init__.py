"""Input views derived from the benchmark tables by plain SQL.

The ``*.sql`` files hold Spark SQL.  ``sql_text(name, "duckdb")`` gives the same
view for DuckDB; only the ordered string aggregate is spelled differently.
"""

from __future__ import annotations

import re
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_HERE = Path(__file__).parent
_TABLES = (
    "region nation customer supplier part orders lineitem events documents conversations".split()
)
_LISTAGG = re.compile(
    r"listagg\((\w+), (chr\(10\)|',')\) within group \(order by ([^)]*)\)"
)

VIEW_NAMES = sorted(p.stem for p in _HERE.glob("v_*.sql"))


@lru_cache(maxsize=None)
def sql_text(name: str, dialect: str = "spark") -> str:
    text = (_HERE / f"{name}.sql").read_text().strip()
    if dialect == "duckdb":
        text = _LISTAGG.sub(r"string_agg(\1, \2 order by \3)", text)
    return text


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named view over the tables in ``sf_dir``."""
    text = sql_text(name)
    for table in _TABLES:
        if re.search(rf"\b{table}\b", text):
            spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    return spark.sql(text)
