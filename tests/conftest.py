import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_SMALL = "/root/testdata/sf0.001"
EVENTS = tempfile.mkdtemp(prefix="tuneval-test-events-")


@pytest.fixture(scope="session")
def spark():
    from tuneval.session import get_session
    s = get_session("local[4]", app="tuneval-tests", shuffle_partitions=4, extra={
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": f"file://{EVENTS}",
        "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false",
        "spark.sql.maxMetadataStringLength": "2000"})
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tuneval-test-ckpt-"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def plan_log(spark):
    from plan_log import PlanLog
    return PlanLog(EVENTS, spark)
