"""The shared-folder helper reads the session's checkpoint folder and only makes its own when none is named."""

import pytest

from tracesift.session import shared_dir


class _Conf:
    def __init__(self, value, writable):
        self.value, self.writable = value, writable

    def get(self, key, default=None):
        return self.value if self.value is not None else default

    def set(self, key, value):
        if not self.writable:
            raise RuntimeError("read-only")
        self.value = value


class _SC:
    def __init__(self, ckpt=None, master="local[2]"):
        self.ckpt, self.master = ckpt, master

    def getCheckpointDir(self):
        return self.ckpt

    def setCheckpointDir(self, d):
        self.ckpt = d


class _Spark:
    def __init__(self, value, writable=True, ckpt=None):
        self.conf = _Conf(value, writable)
        self.sparkContext = _SC(ckpt)


def test_uses_named_folder():
    s = _Spark("/shared/ckpt")
    p = shared_dir(s, "x")
    assert p.startswith("/shared/ckpt/x-")
    assert s.sparkContext.ckpt == "/shared/ckpt"


def test_falls_back_only_when_unset_even_if_conf_is_read_only():
    s = _Spark(None, writable=False)
    p = shared_dir(s, "y")
    assert s.sparkContext.ckpt is not None and p.startswith(s.sparkContext.ckpt.rstrip("/") + "/y-")


def test_context_checkpoint_dir_is_used():
    s = _Spark(None, ckpt="hdfs://nn/ckpt/abc")
    assert shared_dir(s, "z").startswith("hdfs://nn/ckpt/abc/z-")


def test_no_machine_local_folder_on_a_cluster():
    s = _Spark(None)
    s.sparkContext.master = "spark://host:7077"
    with pytest.raises(ValueError):
        shared_dir(s, "x")
