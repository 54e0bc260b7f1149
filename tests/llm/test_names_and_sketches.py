"""URL words and rules, and sketches, against brute force on the given tables."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest

from terseframe.llm import bottom_k, url_words
from terseframe.llm.queries import QUERIES

rnd = random.Random(3)


def all_splits(name):
    for n in range(len(name)):
        for cuts in itertools.combinations(range(1, len(name)), n):
            edges = [0, *cuts, len(name)]
            yield [name[a:b] for a, b in zip(edges, edges[1:])]


def test_viterbi_finds_the_best_split():
    s = url_words.Segmenter.of_words({w: rnd.randrange(2, 90) for w in ("rivers", "river", "side", "stone", "to", "tone", "on")})

    def worth(words):
        return sum(max(s.known(w), url_words.UNKNOWN + url_words.PER_LETTER * len(w)) for w in words)

    for name in ("riverside", "riverstone", "toonside", "freegames", "qqside", "a", "casinobest"):
        assert np.isclose(worth(s.split(name)), max(map(worth, all_splits(name))))
    assert s.split("freecasino") == ["free", "casino"] and s.split("") == []
    assert "".join(s.split("ab" * 5000)) == "ab" * 5000


def test_joined_words_split_as_by_the_whole_table(spark):
    names = ["riverstone", "bestriver", "stoneage", "x" * 30 + "river", "ß" * 5000, "river", "stone", "freecasino"]
    parts = [(f"h{i}.net", w) for i in range(40) for w in ("river", "stone")] + [(f"h{i}.net", n) for i, n in enumerate(names)]
    parts += [(f"k{i}.net", "freecasino") for i in range(9)] + [(f"l{i}.net", "y" * 40) for i in range(30)]
    df = spark.createDataFrame(parts, "host string, name string")
    hosts = {}
    for h, n in set(parts):
        hosts[n] = hosts.get(n, 0) + 1
    whole = url_words.Segmenter.of_words({n: c for n, c in hosts.items() if c >= url_words.MIN_HOSTS})
    got = {r.name: r.words for r in url_words.split_names(df).collect()}
    assert got == {n: whole.split(n) for n in hosts}
    assert got["riverstone"] == ["river", "stone"] and got["y" * 40] == ["y" * 40]


def plain_judgement(url):
    """(host, path, rule) of one url, by string operations."""
    rest = (url or "").partition("://")[2]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    rule = ""
    for _, text in url_words.RULES:
        name, _, tail = text.partition("/")
        if ("." + host).endswith("." + name) and path.startswith("/" + tail) and len(text) > len(rule):
            rule = text
    return host, path, rule or None


def test_urls(spark, sf):
    urls = dict(duckdb.sql(f"SELECT page_id, url FROM '{sf}/pages.parquet'").fetchall())
    rows = QUERIES["op9_url_filter"](spark, sf).collect()
    assert len(rows) == len(urls)
    kinds = {text: kind for kind, text in url_words.RULES}
    for r in rows:
        assert (r.host, r.path, r.rule) == plain_judgement(urls[r.page_id])
        assert r.verdict == (kinds[r.rule] if r.rule else "block" if r.score > 0 else "allow")


def test_rules_and_words(spark):
    urls = {
        1: "http://Sub.Example.ORG/es/x?y#z", 2: "https://example.org/en/12", 3: "https://notexample.org/es/", 4: "x://a.com/de/", 5: "x://com/fr/q",
        6: "x://a.com", 7: None, 8: "no scheme", 9: "://", 10: "http://freecasinobonus.net/slots", 11: "http://citylibrary.net/books", 12: "a://b.org#/es/",
    }
    df = spark.createDataFrame(list(urls.items()), "page_id int, url string")
    rows = {r.page_id: r for r in url_words.judge(df).collect()}
    for i, u in urls.items():
        assert (rows[i].host, rows[i].path, rows[i].rule) == plain_judgement(u)
    assert [rows[i].verdict for i in (1, 2, 4, 10)] == ["block"] * 4 and [rows[i].verdict for i in (5, 7, 8, 9, 11)] == ["allow"] * 5


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


@pytest.fixture(scope="module")
def printed(spark, sf):
    texts = dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{sf}/documents.parquet'").fetchall())
    return texts, {r.doc_id: r for r in QUERIES["op4_fingerprints"](spark, sf).collect()}


def test_edited_texts_and_equal_fingerprints(printed):
    texts, rows = printed
    ids = sorted(texts, reverse=True)
    by_text = {}
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], len(texts[i]) // 3
        edited = t[: len(t) - n] + texts[after][:n]
        assert rows[i].n_chars == len(t) and rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text.setdefault(t, set()).add(rows[i].fingerprint)
    assert all(len(f) == 1 for f in by_text.values())


def test_likeness_near_the_true_one(printed):
    texts, rows = printed
    ids = sorted(texts, reverse=True)
    gap = []
    for i, after in zip(ids, ids[1:] + ids[:1]):
        t, n = texts[i], len(texts[i]) // 3
        a = shingle_set(t)
        for b, got in ((shingle_set(t[: len(t) - n] + texts[after][:n]), rows[i].near_edited), (shingle_set(texts[after]), rows[i].near_next)):
            true = len(a & b) / len(a | b) if a | b else 1.0
            gap.append(abs(true - got))
            if len(a | b) < bottom_k.K:
                assert gap[-1] < 1e-9  # the sketch is the whole set
        assert abs(rows[i].distinct_shingles - len(a)) <= 0.35 * len(a)
    assert max(gap) < 0.15 and sum(gap) / len(gap) < 0.02
