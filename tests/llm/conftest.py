import os

import pytest

@pytest.fixture()
def folder(tmp_path, spark):
    """Writes tables to a folder and gives its path."""
    def write(**tables):
        for name, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).write.parquet(os.path.join(tmp_path, f"{name}.parquet"))
        return str(tmp_path)
    return write

