"""Every registered query of the panel operators against its SQL, and the others for their rows."""

import pytest

from tests.compare import connect, difference
from weeklane.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, con, name):
    assert difference(spark, con, QUERIES[name], SQL[name], SF) is None


@pytest.mark.parametrize("name", ["seasonal_strength", "adf_stat", "stationarity", "guardrail_notes", "grouped_nb_glm", "alpha_sweep", "forecast_slices"])
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
