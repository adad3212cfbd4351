"""Components of a few links, whatever the number of partitions that shuffles deal to."""

import pytest

from tallyloom.llm import components
from tallyloom.llm.components import connected_components


@pytest.fixture
def dealt(spark):
    """Shuffles of 64 partitions that Spark doesn't put together."""
    own = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("links_per_part, most_parts", [(50_000, 1), (7, 64)])
def test_few_links_take_few_tasks(dealt, monkeypatch, links_per_part, most_parts):
    """A path, a star and a link to itself; a round of few links isn't dealt to all partitions."""
    monkeypatch.setattr(components, "LINKS_PER_PART", links_per_part)
    links = [(i, i + 1) for i in range(9)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    found = connected_components(dealt.createDataFrame(links, "u long, v long"))
    assert {(r.node, r.component) for r in found.collect()} == {(i, 0) for i in range(10)} | {(i, 100) for i in range(100, 130)}
    assert found.rdd.getNumPartitions() <= most_parts
