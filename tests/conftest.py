import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + ROOT + "/tests" + os.pathsep + os.environ.get("PYTHONPATH", "")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from joust.session import session

    os.environ.setdefault("JOUST_DRIVER_MEMORY", "4g")
    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    yield s
    s.stop()


def spec_entities(spark, n):
    from pyspark.sql import functions as F

    return spark.range(n).select(F.format_string("E%02d", "id").alias("entity"), F.concat(F.lit("C"), (F.col("id") % 6).cast("string")).alias("construct"))
