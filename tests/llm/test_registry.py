import pytest
from helpers import same_as_sql

from wardspan.llm import registry


@pytest.mark.parametrize("name", ["secret_counts", "digest_edited_texts"])
def test_side_queries_match_sql(spark, sf_dir, name):
    same_as_sql(registry.QUERIES[name](spark, sf_dir), registry.ORACLES[name], sf_dir)


def test_registered_once_each():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert sorted(n.split("_")[0] for n in registry.QUERIES if n.startswith("op")) == sorted(f"op{i}" for i in range(1, 11))
