"""Healing reads the written metadata, not the tables it was parsed from, however often it needs them."""

from pathlib import Path

import pytest

from loreweave.queries import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(DATA).exists(), reason="needs the test tables")
@pytest.mark.parametrize("key", ["heal_over_commits", "post_commit", "heal_dependencies"])
def test_metadata_is_parsed_once(spark, key):
    assert not [f for f in queries()[key](spark, DATA).inputFiles() if "lineitem" in f]
