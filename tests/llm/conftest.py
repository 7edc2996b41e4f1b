import os

import pytest


@pytest.fixture(scope="session")
def larger_dir(sf_dir):
    folder = sf_dir.replace("sf0.001", "sf0.01")
    if not os.path.isdir(folder):
        pytest.skip("no larger test tables here")
    return folder
