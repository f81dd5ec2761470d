"""Queries against their SQL on a few odd rows put into the smallest tables."""

import duckdb
import pytest
from oracle import compare, connect

from listloom.plans.catalog import load

SMALL = "/root/testdata/sf0.001"
QUERIES, SQL = load()


@pytest.fixture
def same(spark, tmp_path):
    """Checks a query over tables given as SQL over the smallest ones."""

    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            con.execute(f"COPY ({sql.format(t=f'{SMALL}/{t}.parquet')}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        diff, *_, n = compare(spark, connect(str(tmp_path)), name, QUERIES[name], SQL[name], str(tmp_path))
        assert diff is None, diff
        assert n > 0

    return check


def test_hosts_known_only_by_unwanted_urls(same):
    urls = "('https://www.spam-farm.example.org/en/9'), ('https://a.example.org/en/7?spam'), ('https://b.example.org/fr/8'), ('https://b.example.org/en/spam'), ('spam')"
    same("flt8_url_rules", pages=f"SELECT (row_number() OVER ())::BIGINT AS page_id, url, '' AS html FROM (VALUES {urls}) AS v(url)")


@pytest.mark.parametrize("name", ["ingest_pages", "src6_html_fields", "src6_html_nested"])
def test_references_cut_short(same, name):
    cut = "'<html lang=\"en\"><nav><a href=\"/x?a=1&copy=2\">y</a></nav><h1>Night &amp; day &amp</h1><p>One &amp</p><p>Two &copy &middot; &quot</p><div class=\"ad\">Bar &amp;&amp</div>'"
    same(name, pages=f"SELECT page_id, url, CASE WHEN page_id % 3 = 0 THEN {cut} ELSE html END AS html FROM '{{t}}'")


def test_no_line_long_enough_for_a_title(same):
    same("src8_sections", documents="SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'De.' WHEN 1 THEN 'A' || chr(10) || 'Bcde' ELSE text END AS text FROM '{t}'")


def test_no_date_inside_other_words_and_numbers(same):
    texts = "['Card 4497672581733027 aoution', 'by 12 Marshalls', '1234 mai', 'a 7' || chr(10) || 'junior 112/12/2024']"
    same("src9_posts", documents=f"SELECT doc_id, ({texts})[doc_id % 4 + 1] AS text FROM '{{t}}'")
