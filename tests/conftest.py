import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from labwave import names as N  # noqa: E402
from labwave.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"

SAMPLE_SCHEMA = T.StructType([
    T.StructField(N.PATIENT, T.LongType()),
    T.StructField(N.SAMPLE_ID, T.LongType()),
    T.StructField(N.SAMPLE_TIME, T.TimestampNTZType()),
    T.StructField(N.CODE, T.StringType()),
    T.StructField(N.VALUE, T.DoubleType()),
    T.StructField(N.REFTEXT, T.StringType()),
])

INFUSION_SCHEMA = T.StructType([
    T.StructField(N.PATIENT, T.LongType()),
    T.StructField(N.INFNO, T.IntegerType()),
    T.StructField(N.SEX, T.IntegerType()),
    T.StructField(N.STOP, T.IntegerType()),
    T.StructField(N.INF_START, T.TimestampNTZType()),
])

T0 = datetime(2024, 1, 1, 10, 0)


def hours(h: float) -> datetime:
    return T0 + timedelta(hours=h)


@pytest.fixture(scope="session")
def spark():
    return local_session(4, shuffle_partitions=8, app="labwave-tests")


@pytest.fixture
def samples(spark):
    def make(rows):
        full = []
        for i, r in enumerate(rows):
            r = list(tuple(r) + (None,) * (6 - len(r)))
            if isinstance(r[4], int):
                r[4] = float(r[4])
            r = tuple(r)
            full.append(r if r[1] is not None else (r[0], i) + r[2:])
        return spark.createDataFrame(full, SAMPLE_SCHEMA)
    return make


@pytest.fixture
def infusions(spark):
    def make(rows):
        return spark.createDataFrame([tuple(r) for r in rows], INFUSION_SCHEMA)
    return make
