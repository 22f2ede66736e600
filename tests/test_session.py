from pathlib import Path
from urllib.parse import urlparse

from feedloom import session


def test_tables_written_in_a_scratch_are_removed(spark):
    with session.scratch(spark):
        df = session.written(spark.range(5).toDF("id"), "some")
        folder = Path(urlparse(session._scopes[-1][0]).path)
        assert folder.exists() and df.count() == 5
    assert not folder.exists()
    assert session.written(spark.range(3).toDF("id"), "kept").count() == 3
