import pytest

from trafficlens.session import build_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        app="tests",
        master="local[4]",
        spark__ui__enabled="false",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="6g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def log_of(spark):
    """Access-log DataFrame from lines, all of which must be good."""
    from trafficlens.functions.clf import parse_clf
    from trafficlens.sources.text_log import good_rows

    def make(lines):
        parsed = parse_clf(spark.createDataFrame([(line,) for line in lines], "line string"))
        assert parsed.where("reject_reason is not null").count() == 0
        return good_rows(parsed)

    return make
