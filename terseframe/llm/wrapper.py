"""Main text of pages by wrapper induction over same-host pages.

The pages of a host are dealt by a hash of page_id and html into runs of about `run_pages`, as many as the host's
number of pages asks for, so that one host may fill many tasks and a page's run does not depend on
partitions. A run of more (equal rows) is cut in the order of page_id. The pages' block trees are
aligned to the run's template by simple tree matching; nodes that match nothing join the
template. A slot whose text is the same on nearly all pages that have it is template; one
whose text varies is content. Menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments go by their element, class, id or role, and by link share, also
where their words vary. Copies of one article on a host count once, so repeated articles
do not turn into template.

Each page is also held to its whole host: over all pages of
the host, a text that most different articles with the same path of elements have at that
path is template, in runs of any length.

Sibling elements of one kind are matched as one repeated node, which keeps trees small.
"""

import html as entities
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .url_words import host_of

RUN_PAGES = 64
SAME = 0.8  # share of a slot's pages with one text that makes it template
SUPPORT = 4  # pages with different articles that it takes

# HTML element names: fixed values.
RAW = "script|style|template|iframe|svg|select|textarea|title|button|canvas|audio|video"
TO_END = frozenset("script style iframe textarea title".split())  # without an end tag they go on to the end of the page
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q s samp small span strike strong sub "
    "sup time tt u var wbr math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mstyle mpadded "
    "mphantom mfenced menclose mmultiscripts semantics annotation".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset("nav header footer aside form menu dialog head fieldset".split())
FORMS = frozenset("form fieldset".split())
ASKED = frozenset("label legend li dt dd option th".split())  # of a form's own
PART = frozenset("p li dt dd td th tr option h1 h2 h3 h4 h5 h6".split())  # ended by the next of their kind
PAGE = frozenset("html body".split())
# words of class, id and role that name something other than the article
NAMED = regex.compile(
    r"ad|ads|advert\w*|banner|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|footer|header|menu|modal|nav|navbar|"
    r"navigation|newsletter|notice|notification|popup|promo\w*|related|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|"
    r"toolbar|widget|contentinfo|complementary|alert|alertdialog|toc|pagination|login|signup"
)
TALK = frozenset("comment comments commentlist disqus replies respond related".split())  # may hold article elements of its own
# a class like has-sidebar tells what lies inside or beside; in ad-box or nav-2 the last word says nothing
BESIDE = frozenset("has have with without no not show hide above below under beside before after".split())
HOLDER = regex.compile(
    r"[0-9]*|wrap|wrapper|container|content|box|area|list|item|items|inner|outer|block|section|bar|slot|unit|links?|buttons?|text|body|author|meta|"
    r"top|bottom|left|right|main|primary|secondary|form|title|row|group|panel"
)
# a quote opens a value only right after the sign of equality; one that is never closed ends with its tag
VALUE = r"\"[^\"]*\"|'[^']*'|[^\s>]*"
ATTRS = rf"(?:[\s/]++|=?[^\s/>=]++(?:\s*+=\s*+(?:{VALUE}))?+)*+"
TOKEN = regex.compile(
    rf"<!--.*?(?:-->|$)|<(?P<raw>{RAW})(?=[\s/>])(?P<own>{ATTRS})>|<[!?][^>]*(?:>|$)|"
    rf"<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attr>{ATTRS})>",
    regex.S | regex.I,
)
OPEN = regex.compile(r"<[a-zA-Z!/?][^>]*$")
ENDS = {tag: regex.compile(rf"</{tag}\s*>", regex.I) for tag in RAW.split("|")}
EMPTY = regex.compile(r"(?:.*[\s\"'])?/", regex.S)  # attributes of <svg ... />
ATTR = regex.compile(r"""(=?[^\s/>=]++)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?+""")
TOLD = regex.compile("class|id|role", regex.I)


@dataclass
class Node:
    """An element with its child elements and blocks of text in page order."""

    tag: str
    kind: str = ""
    children: list["Node | Block"] = field(default_factory=list)
    dropped: bool = False
    by_name: bool = False  # dropped for what its names say, and not for talk
    form: bool = False


@dataclass
class Block:
    """Text between two block boundaries, white space still raw; `linked` counts letters inside links."""

    parts: list[str]
    linked: int = 0
    text: str = ""
    path: int = 0


DIGITS, JOINTS = regex.compile("[0-9]+"), regex.compile("[-_]+")


@lru_cache(maxsize=4096)
def named(names: str) -> frozenset[str]:
    """The words by which class, id and role name something other than the article.

    A token counts whole, by its last word, or by its first where only words for holders follow.
    """
    out, before = set(), ""
    for token in names.split():
        words = [w for w in JOINTS.split(token) if w]
        told, before = before in BESIDE, token
        if words and words[0] not in BESIDE and not told:
            if all(map(HOLDER.fullmatch, words[1:])):
                words = words[:1]
            if NAMED.fullmatch(words[-1]):
                out.add(words[-1])
    return frozenset(out)


def parse(page: str) -> Node:
    """A tree of block elements; inline elements dissolve into the text around them."""
    root = Node("#page", "#page")
    stack, links, block = [root], 0, None
    at = 0

    def say(raw: str) -> None:
        nonlocal block
        if not raw:
            return
        text = entities.unescape(raw)
        if block is None:
            if not text.strip():
                return
            block = Block([])
            stack[-1].children.append(block)
        block.parts.append(text)
        if links:
            block.linked += len(text.strip())

    unended: set[str] = set()
    while m := TOKEN.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        tag, attr = m["tag"] or m["raw"], m["attr"] or m["own"] or ""
        if tag is None:
            continue
        tag = tag.lower()
        if m["raw"]:
            close = None if tag in unended or EMPTY.fullmatch(m["own"]) else ENDS[tag].search(page, at)
            if close or EMPTY.fullmatch(m["own"]) or tag in TO_END:
                if block is not None:
                    block.parts.append(" ")
                at = close.end() if close else at if EMPTY.fullmatch(m["own"]) else len(page)
                continue
            unended.add(tag)  # read on as an element like others
        if tag in INLINE:
            if tag == "br":
                if block is not None:
                    block.parts.append(" ")
            elif tag == "a":
                links = 0 if m["end"] else 1
            continue
        block, links = None, 0
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if stack[i].tag in ("article", "main", "body") and tag in PART:
                    break
            continue
        if tag in PART or tag not in PAGE:
            while stack[-1].tag == "p" or (tag in PART and stack[-1].tag == tag):
                stack.pop()
        attrs: dict[str, str] = {}
        for k, a, b, c in ATTR.findall(attr) if TOLD.search(attr) else ():
            attrs.setdefault(k.lower(), (a or b or c).lower())
        names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).strip() if attrs else ""
        node = Node(tag, f"{tag}.{attrs.get('class', '')}#{DIGITS.sub('0', attrs.get('id', ''))}")
        words = named(names) if names and tag not in ("html", "body", "article", "main") else frozenset()
        node.dropped = tag in DROPPED or bool(words)
        node.by_name = bool(words) and tag not in DROPPED and not words & TALK
        node.form = tag in FORMS and not words
        if tag == "header" and any(n.tag in ("article", "main") for n in stack):
            node.dropped = False  # an article's own heading
        stack[-1].children.append(node)
        if tag not in VOID:
            stack.append(node)
    if at < len(page):
        say(OPEN.sub("", page[at:]))
    return root


def blocks(node: Node) -> Iterator[Block]:
    """Blocks that are not inside a dropped element, in page order."""
    todo = [iter(node.children)]
    while todo:
        item = next(todo[-1], None)
        if item is None:
            todo.pop()
        elif isinstance(item, Block):
            yield item
        elif not item.dropped:
            todo.append(iter(item.children))


def articles_of(root: Node) -> list[Node]:
    """All outermost article and main elements that are not inside a dropped part, in page order."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            out.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not c.dropped]
    return out


def unwrap(root: Node) -> None:
    """Opens what stands around the page's text though it is named for something else.

    Wrappers named for what lies beside the article, and forms, are opened where more text is in their
    articles than outside of all; without articles, forms are opened that hold more text,
    beside their labels and lists, than there is outside of all.
    """
    if articles_of(root):
        return
    found, forms, todo = [], [], [(root, ())]
    while todo:
        node, closed = todo.pop()
        if node.tag in ("article", "main"):
            found.append((node, closed))
            continue
        inner = [c for c in node.children if isinstance(c, Node) and (c.by_name or c.form or not c.dropped)]
        forms += [(c, closed + (c,)) for c in inner if c.form and c.tag == "form" and all(n.form for n in closed)]
        todo += [(c, closed + (c,) * c.dropped) for c in inner]
    outside = sum(len(b.text) for b in blocks(root))
    if found:
        if sum(len(b.text) for x, _ in found for b in blocks(x)) > outside:
            for _, closed in found:
                for n in closed:
                    n.dropped = False
        return
    for form, closed in forms:
        if told(form) > outside:
            for n in (*closed, *fields(form)):
                n.dropped = False


def fields(form: Node) -> list[Node]:
    """The fieldsets of a form that are not inside a dropped part of another kind."""
    out, todo = [], [form]
    while todo:
        inner = [c for c in todo.pop().children if isinstance(c, Node) and (c.form or not c.dropped)]
        out += [c for c in inner if c.form]
        todo += inner
    return out


def told(form: Node) -> int:
    """Letters in a form that are not in its labels and lists, fieldsets included."""
    n, todo = 0, [form]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Block):
                n += len(c.text)
            elif (c.form or not c.dropped) and c.tag not in ASKED:
                todo.append(c)
    return n


@dataclass
class Slot:
    """A template node: one kind of element, its repeated children, and the texts seen here."""

    kind: str
    slots: list["Slot"] = field(default_factory=list)
    pages: set[int] = field(default_factory=set)
    texts: dict[str, set[int]] = field(default_factory=dict)


TEXT = "#text"


def folded(node: Node) -> list[tuple[str, list]]:
    """Children by kind, neighbours of one kind together."""
    out: list[tuple[str, list]] = []
    for c in node.children:
        kind = TEXT if isinstance(c, Block) else c.kind
        if out and out[-1][0] == kind:
            out[-1][1].append(c)
        else:
            out.append((kind, [c]))
    return out


def match(slots: list[Slot], groups: list[tuple[str, list]]) -> list[tuple[int, int]]:
    """Order-keeping pairs of equal kinds, as many as can be (simple tree matching of one level)."""
    a, b = [s.kind for s in slots], [k for k, _ in groups]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        for j in range(len(y) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if x[i] == y[j] else 0)
    pairs, i, j = [(k, k) for k in range(head)], 0, 0
    while i < len(x) and j < len(y):
        if x[i] == y[j] and best[i][j] == best[i + 1][j + 1] + 1:
            pairs.append((head + i, head + j))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            i += 1
        else:
            j += 1
    return pairs + [(len(a) - t, len(b) - t) for t in range(tail, 0, -1)]


def align(slot: Slot, node: Node, page: int, where: dict[int, Slot]) -> None:
    """Match a page's tree into the template, which grows by what it lacks; `where` gets each block's slot."""
    todo = [(slot, [node])]
    while todo:
        slot, nodes = todo.pop()
        for n in nodes:
            groups = folded(n)
            pairs = match(slot.slots, groups)
            at = {j: slot.slots[i] for i, j in pairs}
            grown, used = [], 0
            ends = {j: i for i, j in pairs}
            for j, (kind, _) in enumerate(groups):
                if j in at:
                    grown += slot.slots[used : ends[j] + 1]
                    used = ends[j] + 1
                else:
                    at[j] = Slot(kind)
                    grown.append(at[j])
            slot.slots = grown + slot.slots[used:]
            for j, (kind, members) in enumerate(groups):
                s = at[j]
                s.pages.add(page)
                if kind == TEXT:
                    for b in members:
                        s.texts.setdefault(b.text, set()).add(page)
                        where[id(b)] = s
                else:
                    todo.append((s, members))


def mark(text: str, seed: int = 0) -> int:
    """A signed 64-bit hash."""
    n = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return n - (1 << 64) if n >> 63 else n


def read(page: str | None) -> Node:
    """The page's tree with clean texts; each block's path is a hash of the kinds of elements around it."""
    root = parse(page or "")
    todo = [(root, 0)]
    while todo:
        node, path = todo.pop()
        for c in node.children:
            if isinstance(c, Block):
                c.text, c.path = " ".join("".join(c.parts).split()), path
            else:
                todo.append((c, mark(c.kind, path & (1 << 64) - 1)))
    unwrap(root)
    return root


def spot(b: Block) -> int:
    return mark(b.text, b.path & (1 << 64) - 1)


def voice_of(root: Node) -> str:
    """The longest block of the articles, or of the page where it has none."""
    return max((b.text for x in articles_of(root) or [root] for b in blocks(x)), key=len, default="")


def extract_run(pages: list[str | None], template_spots: frozenset[int] = frozenset()) -> list[str]:
    """Main text of each page of one host; `template_spots` are those that the whole host shows to be template."""
    trees = [read(p) for p in pages]
    inside = [{id(b) for x in articles_of(t) for b in blocks(x)} for t in trees]
    # pages whose longest block is the same are copies of one article and count once
    longest = [voice_of(t) for t in trees]
    voice: dict[str, int] = {}
    for i, text in enumerate(longest):
        voice.setdefault(text, i)
    speaks = [voice[text] for text in longest]
    template, where = Slot("#page"), [dict() for _ in trees]
    for i, t in enumerate(trees):
        align(template, t, speaks[i], where[i])
    out = []
    for i, t in enumerate(trees):
        kept = []
        for b in blocks(t):
            s = where[i].get(id(b))
            fixed = s is not None and len(s.pages) >= SUPPORT and len(s.texts.get(b.text, ())) >= SAME * len(s.pages)
            fixed = fixed or bool(template_spots) and spot(b) in template_spots
            own = id(b) in inside[i]
            if b.text and not fixed and (own or b.linked < 0.6 * len(b.text)):
                kept.append((own, b.text))
        # text outside the articles goes, unless it is the greater part
        if 2 * sum(len(x) for own, x in kept if own) >= sum(len(x) for _, x in kept):
            kept = [k for k in kept if k[0]] or kept
        out.append("\n".join(x for _, x in kept))
    return out


def _evidence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(site, path, spot, article) of every block that is not inside a dropped part, once a page."""
    for batch in batches:
        rows: list[tuple[int, int, int, int]] = []
        for html, site in zip(batch["html"].tolist(), batch["site"].tolist()):
            root = read(html)
            found = [b for b in blocks(root) if b.text]
            if found:
                article = mark(voice_of(root))
                rows += {(site, b.path, spot(b), article) for b in found}
        if rows:
            yield pd.DataFrame(np.array(rows, np.int64), columns=["site", "path", "spot", "article"])


def host_template(rows: DataFrame) -> DataFrame:
    """site (hash of host) and spots: the texts at a path that SAME of the host's different articles with that path have."""
    seen = materialize(rows.select("html", "site").mapInPandas(_evidence, "site long, path long, spot long, article long"))
    often = seen.groupBy("site", "path", "spot").agg(F.min("article").alias("lo"), F.max("article").alias("hi"))
    often = materialize(often.filter("lo < hi").select("site", "path", "spot"))  # texts of one article only are most, and go first
    met = seen.join(often, ["site", "path", "spot"]).distinct().groupBy("site", "path", "spot").agg(F.count("*").alias("n"))
    met = met.filter(F.col("n") >= SUPPORT)
    paths = seen.select("site", "path", "article").distinct().groupBy("site", "path").agg(F.count("*").alias("all"))
    fixed = met.join(paths, ["site", "path"]).filter(F.col("n") >= SAME * F.col("all"))
    return fixed.groupBy("site").agg(F.collect_set("spot").alias("spots"))


def _extract(run_pages: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, own, spots = [], None, frozenset()

        def out() -> pd.DataFrame:
            texts = extract_run([h[2] for h in held], spots)
            return pd.DataFrame({
                "page_id": pd.array([None if pd.isna(h[0]) else int(h[0]) for h in held], dtype="Int64"),
                "url": [h[1] for h in held], "text": texts, "n_chars": [len(t) for t in texts],
            })

        for batch in batches:
            cols = (batch[c].tolist() for c in ("page_id", "url", "html", "host", "run", "spots"))
            for page_id, url, html, host, number, fixed in zip(*cols):
                if held and ((host, number) != own or len(held) >= 2 * run_pages):
                    yield out()
                    held = []
                if not held:
                    own, spots = (host, number), frozenset(() if fixed is None else map(int, fixed))
                held.append((page_id, url, html))
        if held:
            yield out()

    return run


def main_text(pages: DataFrame, run_pages: int = RUN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty html give an empty text. Pages without a host form runs of their own;
    repeated rows stay rows and count as copies of one article. Other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"), host_of(F.col("url").cast("string")).alias("host"),
    )
    rows = rows.withColumn("site", F.xxhash64("host"))
    sizes = rows.groupBy("site").agg(F.ceil(F.count("*") / run_pages).alias("runs"))
    known = materialize(sizes.join(host_template(rows), "site", "left"))
    rows = rows.join(known, "site")  # broadcast while the table is small
    number = F.pmod(F.xxhash64("page_id", "html"), F.col("runs"))
    dealt = rows.withColumn("run", number).drop("runs").repartition("host", "run").sortWithinPartitions("host", "run", "page_id", F.xxhash64("html"))
    return dealt.mapInPandas(_extract(run_pages), "page_id long, url string, text string, n_chars long")
