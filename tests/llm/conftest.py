import pytest


@pytest.fixture(autouse=True, scope="session")
def surrogate_key(spark):
    """One key for all tests, so that two calls can be compared."""
    spark.conf.set("spark.tracklens.surrogateKey", "tests")
