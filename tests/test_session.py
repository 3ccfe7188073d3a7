"""Where written intermediates go."""

from types import SimpleNamespace

import pytest

from formwright import session


def fake(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_the_named_folder_is_used():
    for master in ("local[8]", "spark://host:7077"):
        assert session.shared_folder(fake(master, "hdfs:///shared/")) == "hdfs:///shared"
    assert session.new_path(fake("yarn", "s3a://b/x"), "t").startswith("s3a://b/x/t-")


def test_a_cluster_needs_a_named_folder():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(fake("yarn"))


def test_a_local_session_may_use_its_own():
    folder = session.shared_folder(fake("local[*]"))
    assert folder == session.shared_folder(fake("local[*]"))
