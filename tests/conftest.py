import os
import tempfile

import pytest

from crosslake.session import get_session


@pytest.fixture(scope="session")
def spark():
    tmp = tempfile.mkdtemp()
    s = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": f"{tmp}/warehouse", "spark.driver.memory": "4g", "spark.driver.extraJavaOptions": f"-Dderby.system.home={tmp}", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("OFF")
    yield s


DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
