import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def docs(spark):
    """Documents of the given texts, with columns whose names could clash."""

    def build(texts, first=0):
        rows = [
            (i, t, "en", "src", None if t is None else len(t)) for i, t in enumerate(texts, first)
        ]
        return spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long"
        )

    return build
