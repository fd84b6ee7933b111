import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    from roadweave.plans.ship import ship

    ship(s)
    yield s
    s.stop()


def lines(spark, rows, srid=None):
    """(id, pts) from {id: [(x, y), ...]}."""
    from roadweave.functions import geometry as G
    from pyspark.sql import functions as F

    data = [(k, [{"x": float(x), "y": float(y)} for x, y in v]) for k, v in rows.items()]
    kind = "string" if isinstance(next(iter(rows), ""), str) else "long"
    df = spark.createDataFrame(data, f"id {kind}, pts {G.LINE}")
    return df.select("id", G.to_metres(F.col("pts"), srid).alias("pts"))
