"""Parts of an article that are no template stay."""

import pytest

from terseframe.llm.wrapper import extract_run

LONG = "long text of a div " * 9

CASES = {
    "<article><p>one</article><article><p>two longer</article>": "one\ntwo longer",
    f"<article>teaser</article><div>{LONG}</div>": "teaser\n" + LONG.strip(),
    "<article><p>a<figure><img><figcaption>caption</figcaption></figure></article>": "a\ncaption",
    "<article><p>sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> is<noscript>b</noscript><object>c</object></article>": "sum x+1 is\nb\nc",
    "<article><p><a href=x>all of it linked</a><p>b</article>": "all of it linked\nb",
    "<div class='has sidebar'><article><p>a</article><aside>x</aside></div>": "a",
    "<div class='content with-sidebar'><div class=post><p>a</div><div class=sidebar>x</div></div>": "a",
    "<article><p>a <svg width='1'/> b<video-player>c</video-player><title-bar>d</title-bar><p>e</article>": "a b\nc\nd\ne",
    "<article><p>a<video src=x><p>b</article><script>var t = 1;": "a\nb",
    "<div class=comments><article><p>said</article></div><div class='ad-box'>x</div><div class=site-header>x</div><article>a</article>": "a",
    "<div class='page sidebar'><article><p>a</article></div><p>": "a",
    "<div class=sidebar><article>teaser</article></div><article>a</article>": "a",
    "<ol class=comment-list><li class=comment><article class=comment-body>said</article></ol><article>a</article>": "a",
    # attributes end where the tokeniser of HTML ends them
    "<article><p data-x=it's>hello</p><p>don't go</p></article>": "hello\ndon't go",
    '<p class="x>hello</p>': "hello",
    "<p class='a b' id = c data-class=ad =y z='>'>hello <b title=a>b>b</b>": "hello b>b",
    "<article><p>a<script src=it's>var x</script> b</p></article><p class=": "a b",
    "a <b": "a",
    # forms around the page
    "<form id=f><nav>x</nav><div><article><p>a b</p></article></div><input></form><footer>f</footer>": "a b",
    f"<body><form action=x><fieldset><label>name</label><p>{LONG}</p></fieldset></form><p>more</p>": "name\n" + LONG.strip() + "\nmore",
    f"<p>{LONG}</p><form><label>mail</label><p>Write to us.</p></form>": LONG.strip(),
    "<article><p>a</p><form><p>Send it to us, now and for ever.</p></form></article>": "a",
    "<article><p>a</p><div class=search><p>what we searched for</p></div></article>": "a\nwhat we searched for",
}


@pytest.mark.parametrize("page", CASES)
def test_parts_stay(page):
    assert extract_run([page]) == [CASES[page]]
