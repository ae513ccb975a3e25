"""Reply trees that are odd: circles, repeated messages, other columns, long texts."""

import pytest

from quern.llm import chat_format

TREE = "conv long, id long, parent long, role string, text string, score double"


@pytest.mark.parametrize("rows", [[(1, 1, 2), (1, 2, 1)], [(1, 1, 2), (1, 2, 1), (1, 3, 1)], [(1, 1, 1)], [(1, 1, None), (2, 5, 6), (2, 6, 7), (2, 7, 5), (2, 8, 5)]])
def test_circles_are_an_error(spark, rows):
    m = spark.createDataFrame([(c, i, p, "user", "x", 1.0) for c, i, p in rows], TREE)
    with pytest.raises(ValueError, match="circle"):
        chat_format.paths(m)


def test_trees_against_a_plain_version(spark):
    rows = [(1, 1, None, "user", "q", 0.5), (1, 2, 1, "assistant", "a </s>", 2.0), (1, 3, 1, "assistant", "b" * 100_000, 1.0), (1, 4, 2, "user", None, None)]
    rows += [(1, 4, 2, None, "z", 9.0), (1, 2, 1, "assistant", "a </s>", 2.0), (None, 1, None, "user", "n", None), (2, 1, 9, None, None, 3.0)]
    m = spark.createDataFrame([(*r, "clash", 1) for r in rows], TREE + ", leaf string, up int").repartition(3)
    for branches, leaves in ((1, {(1, 4), (None, 1), (2, 1)}), (None, {(1, 3), (1, 4), (None, 1), (2, 1)})):
        got = {(r.conv, r.leaf): [t[:2] for t in chat_format.read_back(r.formatted)] for r in chat_format.trees(m, branches).collect()}
        assert set(got) == leaves
        # of the two messages 4 the one without a role and of the lesser text counts
        assert got[1, 4] == [("user", "q"), ("assistant", "a </s>"), ("", "z")]
        assert got[2, 1] == [("", "")]
    assert got[1, 3] == [("user", "q"), ("assistant", "b" * 100_000)]
    assert chat_format.trees(spark.createDataFrame([], TREE)).count() == 0


def test_a_deep_path(spark):
    m = spark.createDataFrame([(1, i, i - 1 if i else None, "user", str(i), 1.0) for i in range(300)], TREE)
    (r,) = chat_format.trees(m).collect()
    assert [t[1] for t in chat_format.read_back(r.formatted)] == [str(i) for i in range(300)]
