import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from srcatlas.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def elements(spark):
    """Make ``elements`` rows: elements(("repo", "path", "language", "kind", "name", *position), ...)."""
    from srcatlas import model

    def make(*rows):
        counters, out = {}, []
        for repo, path, language, kind, name, *position in rows:
            key = (repo, path, kind)
            counters[key] = counters.get(key, -1) + 1
            position = (list(position) + [0] * 4)[:4]
            out.append((repo, path, language, kind, counters[key], "", name, *position))
        return spark.createDataFrame(out, model.ELEMENTS)

    return make
