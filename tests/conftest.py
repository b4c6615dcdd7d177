import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from sigilite.session import get_spark

    return get_spark("tests", 4)


UNIT = "unit_seq bigint, path string, text string"


@pytest.fixture(scope="session")
def scan_texts(spark):
    """Findings of (path, text) pairs, as rows in the order of reports."""
    from sigilite.catalog import Config
    from sigilite.operators.scan import ordered, scan

    def run(*units, config=Config(), **options):
        df = spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(units)], UNIT)
        return ordered(scan(df, config, **options)).collect()

    return run
