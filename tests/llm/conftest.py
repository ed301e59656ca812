import datetime as _dt
import os
import sys

import pytest

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.path.dirname(os.path.abspath(__file__))]


@pytest.fixture
def sf_dir(tmp_path):
    """Write small tables as <dir>/<name>.parquet and return the folder."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    def write(**tables):
        for name, columns in tables.items():
            pq.write_table(pa.table(columns), tmp_path / f"{name}.parquet")
        return str(tmp_path)

    return write


@pytest.fixture
def documents(sf_dir):
    """A documents table (with clashing extra columns) from (doc_id, text) rows."""
    import pyarrow as pa

    def write(rows, **tables):
        ids, texts = [r[0] for r in rows], [r[1] for r in rows]
        n = len(rows)
        return sf_dir(
            documents={
                "doc_id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.string()), "lang": pa.array(["en"] * n, pa.string()), "source": pa.array([None] * n, pa.string()),
                "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "spans": pa.array([1] * n, pa.int64()), "label": pa.array([_dt.date(2024, 1, 1)] * n, pa.date32()), "score": pa.array([0.5] * n, pa.float64()),
            },
            **tables,
        )

    return write
