import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from nearfield.functions.embedders import Models  # noqa: E402
from nearfield.session import local_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session("tests", 4, **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("scratch")),
    })
    yield session
    session.stop()


@pytest.fixture()
def models():
    return Models()


PRODUCTS = [
    (1, "Garden Chair", "Folding wooden chair for the patio"),
    (2, "Running Shoes", "Light shoes with a cushioned sole for long distances"),
    (3, "Coffee Maker", "Programmable machine that brews twelve cups"),
    (4, "Yoga Mat", "Thick mat with a non-slip surface"),
    (5, "Desk Lamp", "Dimmable lamp with a charging port"),
    (6, "Backpack", "Waterproof bag with a laptop sleeve"),
    (7, "Water Bottle", "Steel bottle that keeps drinks cold"),
    (8, "Piano", "Digital piano with weighted keys"),
    (9, "Tent", "Two person tent for three seasons"),
    (10, "Blender", "Powerful blender for smoothies and soup"),
]


@pytest.fixture()
def products(spark):
    return spark.createDataFrame(PRODUCTS, "id bigint, name string, description string")


@pytest.fixture()
def product_vectors(spark):
    """Row n is 0.01 everywhere and 1.0 at position n."""
    rows = [(n, [1.0 if i == n else 0.01 for i in range(384)]) for n in range(1, 11)]
    return spark.createDataFrame(rows, "id bigint, embedding array<float>")
