import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
from tests_odd import ODD  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with an extra column and names that clash with the operators' own, over a few partitions."""

    def make(rows):
        data = [(i, t, "en", "s", None if t is None else len(t), 7, "x") for i, t in rows]
        return spark.createDataFrame(data, DOCS + ", id int, score string").repartition(3)

    return make


@pytest.fixture(scope="session")
def sf(tmp_path_factory):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd(make_docs):
    return make_docs(ODD)
