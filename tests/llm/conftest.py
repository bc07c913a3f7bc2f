import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    from tomefold.llm.common import prepare
    prepare(spark)
    return spark.read.parquet(f"{SF}/documents.parquet")
