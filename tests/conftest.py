import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from comboscore.session import get_spark
    scratch = tempfile.mkdtemp(prefix="run-tests-")
    s = get_spark(master="local[4]", shuffle_partitions=8,
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                         "spark.local.dir": scratch})
    yield s
    s.stop()
