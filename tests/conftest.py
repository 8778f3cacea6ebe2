import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
    s = (
        SparkSession.builder.master("local[4]").appName("gleaner-tests")
        .config("spark.sql.shuffle.partitions", "2").config("spark.sql.codegen.wholeStage", "false").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.executorEnv.PYTHONPATH", str(ROOT))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from gleaner.shipping import ship

    ship(s)
    yield s
    s.stop()


@pytest.fixture
def tree(tmp_path, spark):
    from helpers import Tree

    return Tree(tmp_path, spark)
