import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tidemark.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    return s


def rows(df, *order):
    """Collected rows as tuples, sorted."""
    return sorted((tuple(r) for r in (df.select(*order) if order else df).collect()), key=repr)


def assert_causal(op, df, cut, ts="ts"):
    """Changing rows at or after ``cut`` must not move results before it."""
    from pyspark.sql import functions as F
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    later = df.select(*[F.when(F.col(ts) >= cut, F.col(c) * 1.7 + 3).otherwise(F.col(c)).alias(c) if c in doubles else F.col(c) for c in df.columns])
    before = lambda d: rows(op(d).where(F.col(ts) < cut))
    assert before(df) == before(later)
