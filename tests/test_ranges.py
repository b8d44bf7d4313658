"""Several ranges of a timeline at once."""

from pyspark.sql import functions as F

from gleanwork import catalog, catalog_index  # noqa: F401
from gleanwork.operators import timelines


def test_each_range_as_a_query_of_its_own(spark):
    rows = [("a", k, "day", 9000 + k, 9000 + k + k % 40, False, False, True, None) for k in range(900)] + [("a", 1000, "year", 25, 26, False, False, True, None), ("b", 1001, "day", 9100, 9100, False, False, True, None), ("a", 5, "day", 9500, 9500, False, False, False, None)]
    pos = spark.createDataFrame(rows, timelines.POSITION)
    for ranges in ([{"scale": "month", "value": 300}, {"scale": "day", "value": 9160}, "1996", ("1995-01", "1995-03")], ["1996", ("1997", None)], [(None, "1994")]):
        want = {(k, r["doc_id"]) for k, x in enumerate(ranges) for r in timelines.query(pos, "a", *(x if isinstance(x, tuple) else (x,))).collect()}
        got = [tuple(r) for r in timelines.query_each(pos, "a", ranges).select("bucket", "doc_id").collect()]
        assert len(got) == len(set(got)) and set(got) == want and want


def test_cells_are_one_aggregate(spark, sf):
    """A union held an aggregate for each of the cells."""
    plan = catalog.QUERIES["tl_cells"](spark, sf).select(F.col("doc_id"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "Union" not in plan
