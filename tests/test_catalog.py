import pytest
from compare import connect, differences
from millrace.plans import arrays, catalog, measures, oracles, publishing, reports

QUERIES = catalog.QUERIES | reports.QUERIES | arrays.QUERIES | publishing.QUERIES | measures.QUERIES
ORACLES = oracles.ORACLES | reports.ORACLES | arrays.ORACLES | publishing.ORACLES | measures.ORACLES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_against_sql(spark, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLES:
        assert not differences(df, connect(sf_dir), ORACLES[name])
    else:
        assert df.count() > 0
