import os

import pytest

from tarnish.sources import views

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_lines_meet_the_large_tables_without_texts(spark):
    plan = views.build_shipments(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above, _, below = plan.partition("Join")
    assert "md5" in above and "md5" not in below
