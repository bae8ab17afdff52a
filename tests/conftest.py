import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from loomlog.session import local_session

    return local_session(4, **{"spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch"))})


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
