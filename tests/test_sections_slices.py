"""Sections do not depend on how many pages a task takes at a time."""

from ringwatch.operators import corpus


def test_sections_of_slices(spark):
    rows = [(i, None if i % 7 == 0 else f"<h1>A{i}</h1><p>one two three {i}</p>" + "<h2>B</h2>four five six" * (i % 3)) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, html string").coalesce(1)
    whole = sorted(tuple(r) for r in corpus.sections(pages, most=1000).collect())
    assert len(whole) > 50 and sorted(tuple(r) for r in corpus.sections(pages, most=3).collect()) == whole
