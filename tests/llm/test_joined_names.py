"""Host names whose blocked word occurs only joined to others."""

from terseframe.llm import url_words


def test_joined_names_are_split(spark):
    names = ["freecasino", "bestpoker", "citylibrary"]
    urls = [(0, f"http://{names[0]}.net/a")] + [(i, f"http://{names[1]}.net/page/{i}") for i in range(1, 40)]
    urls += [(40, f"http://{names[2]}.net/b")] + [(41 + i, f"http://www{i}.{names[0]}.net/c") for i in range(20)]
    urls += [(100 + i, f"http://plain{i}.org/carpet") for i in range(30)]
    rows = url_words.judge(spark.createDataFrame(urls, "page_id int, url string"), rules=()).collect()
    verdicts = {r.page_id: r.verdict for r in rows}
    assert {verdicts[i] for i in (*range(40), *range(41, 61))} == {"block"}
    assert {verdicts[i] for i in (40, *range(100, 130))} == {"allow"}


def test_words_of_several_hosts():
    s = url_words.Segmenter.of_words({"river": 300, "stone": 300, "riverstone": 2, "carpet": 900, "car": 300, "pet": 300, "freecasino": 5000})
    assert s.split("riverstone") == ["river", "stone"] and s.split("carpet") == ["carpet"] and s.split("freecasino") == ["free", "casino"]


def test_words_learnt_from_rules_decide_on_other_hosts(spark):
    """grumblo is in no lexicon: hosts that a rule blocks have it, and hosts that no rule decides are blocked for it."""
    assert "grumblo" not in url_words.LEXICON and "velvet" not in url_words.LEXICON
    urls = [(i, f"http://grumblo.shop{i % 5}.com/de/{i}") for i in range(40)]
    urls += [(100 + i, f"http://citygrumblo.side{i}.com/de/{i}") for i in range(20)]
    urls += [(200 + i, f"http://velvet.house{i % 7}.com/fr/{i}") for i in range(60)]
    urls += [(300, "http://www.citygrumblo.net/en/1"), (301, "http://grumblo.info/x"), (302, "http://velvet.info/x"), (303, "http://quiet.info/de/1"), (304, "http://velvetpage.net/de/")]
    rows = {r.page_id: r for r in url_words.judge(spark.createDataFrame(urls, "page_id int, url string")).collect()}
    assert [rows[i].rule for i in range(300, 305)] == [None] * 5
    assert [rows[i].verdict for i in range(300, 305)] == ["block", "block", "allow", "allow", "allow"]
    assert all(rows[i].verdict == "block" for i in range(40)) and all(rows[200 + i].verdict == "allow" for i in range(60))
