import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewarden.operators import quantiles
from tablewarden.sources.files import directory


@pytest.mark.parametrize("most", [1, 3, 4096])
def test_equal_numpy_at_any_size_of_brackets(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    rng = np.random.default_rng(5)
    columns = {0: rng.normal(size=3000), 1: rng.integers(0, 7, 2000).astype(float), 2: np.array([4.5]), 3: np.repeat([1.0, 2.0, 1e9], [1000, 1, 999]), 5: np.array([-np.inf, 1.0, 2.0, 2.0, 9.0])}
    rows = [(c, float(x), int(n)) for c, xs in columns.items() for x, n in zip(*np.unique(xs, return_counts=True), strict=True)]
    df = spark.createDataFrame(rows + [(7, 3.0, 2), (7, 3.0, 5)], "col int, x double, cnt long").repartition(5)
    got = quantiles.exact_quantiles(df, (0.25, 0.5, 0.75, 1.0))
    assert set(got) == {*columns, 7} and got[7] == ([3.0] * 4, 1)
    for c, xs in columns.items():
        assert got[c][1] == len(np.unique(xs))
        assert got[c][0] == pytest.approx(np.quantile(xs, [0.25, 0.5, 0.75, 1.0]).tolist(), rel=1e-12)


def test_no_rows(spark):
    assert quantiles.exact_quantiles(spark.createDataFrame([], "col int, x double, cnt long"), (0.5,)) == {}


def test_directory(spark):
    d = directory(spark, 600).persist()
    assert len(d.columns) == 11 and d.count() == 600
    assert d.select(d.columns[2:]).distinct().count() == 590
    assert 0 < d.where(F.lower(F.replace("Business_Name", F.lit(" "), F.lit(""))) != F.split_part("Email", F.lit("@"), F.lit(1))).count() < 60
    assert directory(spark, 600).exceptAll(d).isEmpty()
    d.unpersist()
