import os
import sys

import pytest

# many small plans: compiling them well takes longer than running them
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 4g --driver-java-options -XX:TieredStopAtLevel=1 pyspark-shell")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from codeloom.runtime import session

    s = session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def rows():
    """Sorted rows of a DataFrame as tuples in column order."""
    return lambda d: sorted((tuple(r) for r in d.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
