import sys
from pathlib import Path

import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session")
def docs_of():
    """(doc_id, text) of a folder of tables."""

    def read(sf_dir):
        t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
        return list(zip(t["doc_id"], t["text"], strict=True))

    return read
