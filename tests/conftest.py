import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[8]").appName("pagelens-tests")
         .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def page(spark):
    """Signals of one inline HTML page (or of several)."""
    from pagelens.operators.page_signals import page_signals

    def make(*htmls, url="https://www.acme.lt/shop/blue-lamp"):
        rows = [(i, url, h) for i, h in enumerate(htmls)]
        return page_signals(spark.createDataFrame(rows, "page_id long, url string, html string"))

    return make
