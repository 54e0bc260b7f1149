"""Column-level text functions. All are built-in expressions, so they stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Code points Python's str.isspace accepts beyond ASCII, so that offsets and
# word counts agree with str.split on any language.
WS_CHARS = "".join(
    map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
              0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
ASCII_PUNCT = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
FILLERS = [
    "uh", "um", "er", "erm", "ah", "mm", "mhm", "like", "you", "know", "i", "mean",
    "basically", "actually", "literally", "sort", "kind", "of", "right", "so", "well",
]
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
TERM_EDGE = ".,!?;:\"'"
ANCHOR_EDGE = ".,;:!?\"'"
FORCED_TOKENS = ["\n", ".", "!", "?", ","]
# ----------------------------------------------------------------------------

# Java's Unicode mode matches White_Space; the four separators are added to it.
U = "(?U)"
WS = r"[\s\x1c-\x1f]"
NOT_WS = r"[^\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WS_CHARS))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WS_CHARS))


def split_words(c: Column) -> Column:
    """Whitespace words of a text as an array (no offsets)."""
    return F.filter(F.split(c, f"{U}{WS}+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return count_words(F.coalesce(c, F.lit("")))


def count_words(c: Column) -> Column:
    """Words of a non-null text, counted without building the array."""
    return F.regexp_count(c, F.lit(f"{U}{NOT_WS}+"))


def truncate_words(c: Column, n: int) -> Column:
    """First `n` words joined by one space."""
    return F.array_join(F.slice(split_words(c), 1, n), " ")


def split_sentences(c: Column) -> Column:
    """Paragraph lines, then cuts after . ! ? followed by whitespace; blanks dropped."""
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda p: p != "")
    cuts = F.flatten(F.transform(lines, lambda p: F.split(p, rf"{U}(?<=[.!?]){WS}+")))
    return F.filter(F.transform(cuts, strip), lambda s: s != "")


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    bare = F.translate(F.lower(c), ASCII_PUNCT, "")
    no_articles = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return F.array_join(split_words(no_articles), " ")


def normalize_loose(c: Column) -> Column:
    """Lower case, only a-z 0-9 and whitespace kept, single spaces."""
    bare = F.regexp_replace(F.lower(c), rf"{U}[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(bare, rf"{U}{WS}+", " "))


def strip_fillers(c: Column) -> Column:
    """Drop discourse fillers, keep whitespace and punctuation, then tidy the spacing."""
    toks = F.regexp_extract_all(c, F.lit(rf"{U}{WS}+|[.,!?;:]|[^\s.,!?;:]+"), F.lit(0))
    kept = F.filter(
        toks,
        lambda t: t.rlike(r"^\d") | ~F.lower(t).isin(FILLERS),
    )
    joined = F.regexp_replace(F.array_join(kept, ""), rf"{U}{WS}{{2,}}", " ")
    return strip(F.regexp_replace(joined, rf"{U}{WS}+([.,!?;:])", "$1"))


def try_number(c: Column) -> Column:
    """DOUBLE of a decimal literal with optional blanks around it, else NULL."""
    return F.when(strip(c).rlike(NUMBER), strip(c).try_cast("double"))


def coerce_label(c: Column) -> Column:
    """Keep flag of a loosely typed label: 1 for true-like or a number rounding to >= 1."""
    s = strip(c.cast("string"))
    x = try_number(s)
    return F.when(s.isin("true", "True"), 1).when(x > 0.5, 1).otherwise(0)


def parse_labels(c: Column) -> Column:
    """Label string -> ARRAY<STRUCT<word, keep>>; '|' separated or blank separated items."""
    parts = F.when(c.contains("|"), F.split(c, rf"{U}{WS}*\|{WS}*")).otherwise(split_words(c))
    parts = F.filter(F.transform(parts, strip), lambda p: p != "")

    def one(p: Column) -> Column:
        spaced = p.rlike(rf"(?sU)^.*{NOT_WS}{WS}+[01]$")
        head = F.array_join(split_words(F.substr(p, F.lit(1), F.length(p) - 1)), " ")
        comma_word = F.regexp_extract(p, r"(?s)^(.*),([^,]*)$", 1)
        comma_label = F.regexp_extract(p, r"(?s)^(.*),([^,]*)$", 2)
        word = F.when(spaced, head).when(p.contains(","), comma_word).otherwise(p)
        label = F.when(spaced, F.right(p, F.lit(1))).when(p.contains(","), comma_label).otherwise("1")
        return F.struct(word.alias("word"), coerce_label(label).alias("keep"))

    empty = F.array().cast("array<struct<word:string,keep:int>>")
    return F.coalesce(F.transform(parts, one), empty)


def labels_from_pairs(words: Column, labels: Column | None = None) -> Column:
    """Array input of the same operator: aligned word / label arrays, bare words keep."""
    if labels is None:
        return F.transform(words, lambda w: F.struct(w.alias("word"), F.lit(1).alias("keep")))
    return F.zip_with(
        words, labels,
        lambda w, l: F.struct(w.alias("word"), F.when(l.isNull(), 1).otherwise(coerce_label(l)).alias("keep")),
    )


def parse_rate(c: Column) -> Column:
    """'45.0%' -> 0.45, '0.7' -> 0.7, anything unreadable -> 0."""
    s = strip(c.cast("string"))
    x = try_number(F.rtrim(s, F.lit("%")))
    return F.coalesce(F.when(s.endswith("%"), x / 100.0).otherwise(x), F.lit(0.0))


def is_none_anchor(c: Column) -> Column:
    a = F.lower(F.btrim(strip(c), F.lit(ANCHOR_EDGE)))
    return F.coalesce((a == "") | a.startswith("none"), F.lit(True))


def term_form(c: Column) -> Column:
    """Comparison form of a word against question terms."""
    return F.btrim(F.lower(c), F.lit(TERM_EDGE))


def is_yes_no(question: Column) -> Column:
    return F.lower(strip(question)).rlike(r"^(is|are|do|does) ")


def ends_with_question(text: Column, question: Column) -> Column:
    """Remove a question repeated at the end of a compressed text."""
    q, body = strip(question), rstrip(text)
    cut = strip(F.substr(body, F.lit(1), F.length(body) - F.length(q)))
    return F.when((q != "") & body.endswith(q), cut).otherwise(text)


def contains_literal(text: Column, literal: str) -> Column:
    return F.contains(F.lower(text), F.lit(literal.lower()))


def half_up(c: Column, digits: int = 0) -> Column:
    """Rounding of the browser side: halves go up."""
    scale = 10.0 ** digits
    return F.floor(c * scale + 0.5) / scale if digits else F.floor(c + 0.5)


def format_usd(c: Column) -> Column:
    return (
        F.when(c < 0.01, F.format_string("$%.4f", c))
        .when(c < 1, F.format_string("$%.3f", c))
        .otherwise(F.format_string("$%.2f", c))
    )


def format_pct(c: Column) -> Column:
    return F.format_string("%.1f%%", c * 100)


def format_ratio(c: Column) -> Column:
    return F.format_string("%.2fx", c)


def strike(labels: Column, fallback: Column) -> Column:
    """Words joined by a space with dropped words marked; plain text without labels."""
    marked = F.transform(
        labels, lambda x: F.when(x["keep"] == 1, x["word"]).otherwise(F.concat(F.lit("~~"), x["word"], F.lit("~~")))
    )
    return F.when(F.size(labels) > 0, F.array_join(marked, " ")).otherwise(F.coalesce(fallback, F.lit("")))
