import pytest

from tests.compare import connect, difference
from weeklane.llm.queries import oracle_sql, queries


@pytest.mark.parametrize("name", sorted(oracle_sql()))
@pytest.mark.parametrize("where", ["sf0.001", "hard"])
def test_same_as_sql(spark, hard_dir, name, where):
    sf_dir = hard_dir if where == "hard" else f"/root/testdata/{where}"
    con = connect(sf_dir, [t for t in ("documents", "benchmark", "pages", "embeddings")])
    assert difference(spark, con, queries()[name], oracle_sql()[name], sf_dir) is None
