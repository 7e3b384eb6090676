import pytest

from inkspool.catalog import ORACLES, QUERIES

from .conftest import SF
from .oracle import same

#: These plans are covered by the others; they are left to the driver's larger run.
LONG = {"cls7_normalized_features", "cls8_text_score", "cls1_box_features", "cls4_classify_regions", "cls2_weighted_score", "txt8_preprocess_batch", "txt9_text_functions", "join6_positional_zip", "win3_split_control", "sort2_bubble_reading_order"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), ORACLES[name], SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
