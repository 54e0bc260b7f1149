"""Template of a host in runs of any length."""

from terseframe.llm import wrapper


def test_short_runs_use_the_whole_host(spark):
    page = "<article><p>article {0} has words of its own {0}</p></article>"
    notice = "<article><p>article {0} has words of its own {0}</p><p>All rights reserved by us.</p></article>"
    rows = [(i, f"http://a.net/{i}", notice.format(i)) for i in range(9)] + [(20 + i, f"http://b.net/{i}", notice.format(0)) for i in range(9)]
    rows += [(40 + i, f"http://c.net/{i}", (notice if i < 5 else page).format(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for run in (1, 2, 8, 64):
        got = {r.page_id: r.text for r in wrapper.main_text(df, run_pages=run).collect()}
        again = {r.page_id: r.text for r in wrapper.main_text(df.repartition(13), run_pages=run).collect()}
        assert got == again
        assert all(got[i] == f"article {i} has words of its own {i}" for i in range(9))
        assert all("All rights" in got[20 + i] for i in range(9))  # copies of one article say nothing
        assert all(("All rights" in got[40 + i]) == (i < 5) for i in range(9))
