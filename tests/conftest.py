import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from stipple.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    yield s
    s.stop()


@pytest.fixture
def vec_table(spark):
    """numpy rows -> stored cell_id, vec table (plus extra columns)."""
    from stipple.session import cut

    def make(x, **extra):
        names = list(extra)
        rows = [(int(i), [float(v) for v in r], *[str(extra[n][i]) for n in names]) for i, r in enumerate(x)]
        ddl = "cell_id bigint, vec array<double>" + "".join(f", {n} string" for n in names)
        return cut(spark.createDataFrame(rows, ddl), "fixture")

    return make
