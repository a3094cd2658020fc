import os
import threading

import pytest

from larkspur.llm import common


def test_scopes(spark, tmp_path, monkeypatch):
    """Tables go with their scope, unless they were kept; those of other threads don't; an error frees them too."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    names = lambda: sorted(d.rsplit("-", 1)[0] for d in os.listdir(tmp_path / "larkspur"))
    one = lambda name: common.Scratch(spark.range(3).toDF("x"), name)
    outside = one("outside")
    with common.freeing():
        one("a")
        with common.freeing():
            one("b")
            kept = one("c").keep()
            thread = threading.Thread(target=one, args=("other",))
            thread.start()
            thread.join()
        assert names() == ["a", "c", "other", "outside"] and kept.df.count() == 3
        one("d").drop()
        last = one("e").keep()
    assert names() == ["e", "other", "outside"] and last.df.count() == outside.df.count() == 3
    with pytest.raises(ValueError):
        with common.freeing():
            one("f")
            raise ValueError
    assert names() == ["e", "other", "outside"]
