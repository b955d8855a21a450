import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from quarry.session import local_session

    session = local_session(4, spark__sql__shuffle__partitions="4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with ids from 0, in order."""
    return lambda texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
