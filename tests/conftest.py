import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from corpuspack.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Turn {path: text} or {repo: {path: text}} into a table of files."""

    def build(tree):
        if any(not isinstance(v, dict) for v in tree.values()):
            tree = {"demo": tree}
        rows = [
            (repo, path, text, len(text.encode()))
            for repo, paths in tree.items()
            for path, text in paths.items()
        ]
        return spark.createDataFrame(rows, "repo string, path string, content string, size_bytes bigint")

    return build
