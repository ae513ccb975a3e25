"""Sections of Markdown texts as a table."""

from quern.operators import chunk


def test_section_table(spark):
    text = "before\n# One\na\n### Deep\nb\n## Two\nc\nUnder\n---\nd\n### Inner\ne"
    rows = spark.createDataFrame([(1, text), (2, "plain\ntext"), (3, None), (4, "Title\n===\nx"), (5, "# only")], "key int, body string")
    got = {(r.id, r.n): tuple(r)[2:] for r in chunk.section_table(rows, "key", "body").collect()}
    assert got == {
        (1, 0): ("markdown_content", 1, 1, None, None, "before"),
        (1, 1): ("markdown_header_h1", 2, 3, "One", "header_1 One", "# One\na"),
        (1, 2): ("markdown_header_h3", 4, 5, "Deep", "header_3 Deep", "### Deep\nb"),
        (1, 3): ("markdown_header_h2", 6, 7, "Two", "header_1 One > header_2 Two", "## Two\nc"),
        (1, 4): ("markdown_header_h2", 8, 10, "Under", "header_1 One > header_2 Under", "Under\n---\nd"),
        (1, 5): ("markdown_header_h3", 11, 12, "Inner", "header_1 One > header_2 Under > header_3 Inner", "### Inner\ne"),
        (2, 0): ("markdown_content", 1, 2, None, None, "plain\ntext"),
        (3, 0): ("markdown_content", 1, 1, None, None, ""),
        (4, 0): ("markdown_header_h1", 1, 3, "Title", "header_1 Title", "Title\n===\nx"),
        (5, 0): ("markdown_header_h1", 1, 1, "only", "header_1 only", "# only"),
    }
    assert chunk.section_table(rows.limit(0), "key", "body").isEmpty()
