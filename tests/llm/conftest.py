import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_data import EDGE, documents  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return documents(spark, EDGE).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return documents(spark, [])
