import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from fixtures import frame, hard_rows  # noqa: E402

from tasteloom.llm.inputs import prepare  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    prepare(spark)
    return frame(spark, hard_rows())


@pytest.fixture(scope="session")
def empty(spark):
    prepare(spark)
    return frame(spark, [])
