import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from auditlake.session import get_spark

    s = get_spark("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")), "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def schemas(spark):
    """Schemas of the provided tables."""
    names = [f[:-8] for f in os.listdir(DATA) if f.endswith(".parquet")]
    return {n: spark.read.parquet(f"{DATA}/{n}.parquet").schema for n in names}


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    """A folder with every table, none with a row."""
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in schemas(spark).items():
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="session")
def awkward_tables(spark, tmp_path_factory):
    """Tables with rows of nulls, repeated rows and columns whose names operators use inside."""
    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("awkward")
    clashes = ["pages", "unit", "label", "n", "part", "key", "at", "kind", "shard", "state", "facts", "findings", "record", "heavy", "term", "chain", "__task"]
    for name, schema in schemas(spark).items():
        real = spark.read.parquet(f"{DATA}/{name}.parquet").limit(6)
        nulls = spark.range(2).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
        df = real.unionByName(real).unionByName(nulls)
        for c in clashes:
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
