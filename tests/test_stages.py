import pytest
from pyspark.sql import functions as F

from fleetsight.operators import routing
from fleetsight.plans.stages import Stage, chain, replaced


def test_chain_checks_runs_and_reports(spark):
    df = spark.createDataFrame([(1, 0, 0, 10, 20, .9), (2, 0, 0, 5, 5, .1)],
                               "det_id long, x1 int, y1 int, x2 int, y2 int, confidence double")
    sized = Stage("size", routing.with_area, "x1 int, y1 int, x2 int, y2 int")
    sure = Stage("sure", lambda d, least: d.filter(F.col("confidence") >= least), "confidence double", {"least": .5})
    watch = {}
    assert [r.area for r in chain(df, [sized, sure], watch).collect()] == [200]
    assert (watch["size"].get["rows"], watch["sure"].get["rows"]) == (2, 1)
    assert chain(df, replaced([sized, sure], "sure", None)).count() == 2
    with pytest.raises(TypeError, match="size: x1"):
        chain(df.drop("x1"), [sized])
