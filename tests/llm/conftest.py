import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def shared_folder(spark):
    """Cut points of these tests go to a folder that is gone afterwards."""
    with tempfile.TemporaryDirectory() as folder:
        spark.sparkContext.setCheckpointDir(folder)
        yield folder
