"""The shared folder is the cluster's; none is invented."""

import pytest

from trafficlens.session import shared_dir


class _Bare:
    """A session in which no shared folder is set."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        getConf = staticmethod(dict)
        getCheckpointDir = staticmethod(lambda: None)


def test_no_folder_is_made_up():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(_Bare())


def test_configured_folder_is_used(spark):
    assert shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir").rstrip("/")
