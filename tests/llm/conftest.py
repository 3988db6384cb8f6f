import pytest


@pytest.fixture
def scratch(spark):
    from ferry.plans.scratch import Scratch

    return Scratch(spark, "test")
