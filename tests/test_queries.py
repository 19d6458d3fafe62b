import pytest
from compare import assert_same

from corpusmill import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_oracle(spark, sf_dir, name):
    assert_same(plans.QUERIES[name](spark, sf_dir), plans.ORACLES[name], sf_dir)


def test_html_to_markdown(spark, sf_dir):
    rows = plans.QUERIES["html_to_markdown"](spark, sf_dir).collect()
    assert len(rows) == 50 and all("track(" not in r["markdown"] and "[" in r["markdown"] for r in rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_index_of_repeated_urls(spark, tmp_path):
    """Pages of one URL that differ: the entry is of the first by page_id, as DISTINCT ON takes it from a table read in order."""
    page = lambda i, url, lang, n: (i, url, f'<html lang="{lang}">{"x" * n}')
    rows = [page(7, "https://a.example/1", "es", 5), page(3, "https://a.example/1", "es", 9), page(2, "https://a.example/2", "fr", 1), page(1, "https://a.example/2", "fr", 8)]
    rows += [page(5, "https://a.example/3", "de", 2), page(4, "https://a.example/3", "fr", 6), page(8, "https://a.example/4", "de", 3), page(6, "https://a.example/4", "de", 4)]
    spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["source_url"][-1]: (r["language_detected"], r["content_length"], r["max_depth"]) for r in plans.QUERIES["sink_index"](spark, str(tmp_path)).collect()}
    assert got == {"1": ("es", 25, 5), "2": ("fr", 24, 5), "3": ("fr", 22, 5), "4": ("de", 20, 2)}
