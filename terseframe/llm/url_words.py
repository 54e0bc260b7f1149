"""URL filter: allow and block rules, else naive Bayes over segmented host and path words.

Host labels and path parts are split into words by a unigram Viterbi: the split with the
highest product of word probabilities wins; a string that is no word costs as much as its
length suggests. On top of a small starting lexicon, parts between signs are words where
several hosts have them: a part counts once per host, and its spelling, at the price of an
unknown string, is shared among its hosts, so a joined name of one or two hosts is split
while a common word stays whole. Parts that lexicon words make up are never words. No task
holds the table of words: every distinct name meets, by a join on its substrings, the words that occur in it, and is
split by these alone. The split names are written once.

A multinomial naive Bayes over exact words is learnt from distinct URLs: those with a word of the
blocked lexicon count as blocked, others that a rule decides as the rule says; the rest teach nothing. The words of the
rules themselves and the plain lexicon, which only helps to split names, are no features, so a rule can only teach what else its URLs have in common. Words of the blocked lexicon count as SEED
blocked URLs more. A word's odds are drawn towards none by STRENGTH words of the average URL, and URLs are blocked from nine to one on.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..session import materialize

RULES = (
    ("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"),
)

# Starting lexicons: fixed values of this filter.
BLOCKED_WORDS = (
    "adult bet bets betting bingo cams casino casinos clickbait crack cracked dating escort escorts erotic gambling hentai hookup "
    "jackpot keygen lottery malware nude nudes payday phishing pill pills pirate poker porn porno pharma roulette scam sex sexy slots "
    "spam spyware torrent torrents tracker viagra cialis virus warez webcam xxx ads adserver doubleclick popunder popups"
).split()
PLAIN_WORDS = (
    "about academy adult archive art article best blog book books buy center cheap city cloud club com daily data day deal deals "
    "digital download express farm fast forum free game games girls global group guide health help home host hot house info lab land "
    "learn library life link links live local mail market media mobile money music net network new news now online open page pages "
    "park photo play post press pro project radio recipes review sale school science search secure server service shop site soft "
    "space sport sports staff star stats store story stream studio tech the top track travel tv video videos web wiki win wire wood "
    "work world www zone"
).split()
MIN_HOSTS = 2
SHORTEST = 3  # of the table's words; language codes are no parts of names
LONGEST = 24  # of a word inside a name; a whole name may be a longer one
WORD_COUNT = 50.0  # of a lexicon word in the segmenter, before the table's own counts
SEED = 200.0  # blocked URLs that a word of the blocked lexicon stands for in training
STRENGTH = 2.0
CAUTION = float(np.log(9.0))
UNKNOWN = -9.0  # log-probability of an unknown string, and of each of its letters
PER_LETTER = -2.4
SINGLE = -30.0  # of one letter as a word
LEXICON = frozenset({*BLOCKED_WORDS, *PLAIN_WORDS})
LETTERS = "\\p{L}+"


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; null or none: empty."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls; of equal lengths the first given."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


@dataclass
class Segmenter:
    """Unigram Viterbi over exact words with their log-probabilities."""

    exact: dict[str, float]

    @staticmethod
    def of_words(hosts: dict[str, int]) -> "Segmenter":
        """From the number of hosts of each word of the table."""
        own = {w: n for w, n in hosts.items() if w not in LEXICON and not regex.fullmatch(f"(?:{JOINED}){{2,}}", w)}
        total = WORD_COUNT * len(LEXICON) + sum(hosts.get(w, 0) for w in LEXICON) + sum(own.values())
        exact = {w: float(np.log(n / total) + (UNKNOWN + PER_LETTER * len(w)) / n) for w, n in own.items()}
        return Segmenter(exact | {w: float(np.log((WORD_COUNT + hosts.get(w, 0)) / total)) for w in LEXICON})

    def known(self, word: str) -> float:
        return self.exact.get(word, -np.inf) if len(word) > 1 else SINGLE

    def split(self, name: str) -> list[str]:
        """Words of a run of letters; of equally good splits the one whose last word is shortest."""
        best, back = [0.0], [0]
        whole = len(name)
        for end in range(1, whole + 1):
            options = []
            for start in range(max(0, end - LONGEST), end) if end < whole else {0, *range(max(0, end - LONGEST), end)}:
                options.append((best[start] + max(self.known(name[start:end]), UNKNOWN + PER_LETTER * (end - start)), start))
            score, start = max(options)
            best.append(score)
            back.append(start)
        words, end = [], whole
        while end:
            words.append(name[back[end] : end])
            end = back[end]
        return words[::-1]


JOINED = "|".join(sorted(LEXICON))


def table_words(parts: DataFrame) -> DataFrame:
    """word, log_prob: the lexicon, and the names that several hosts have (parts: host, name); written once."""
    names = parts.filter(F.length("name") >= SHORTEST).select("host", F.col("name").alias("word")).distinct()
    hosts = materialize(names.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= MIN_HOSTS))
    lexicon = parts.sparkSession.createDataFrame([(w,) for w in sorted(LEXICON)], "word string").withColumn("given", F.lit(True))
    every = hosts.join(F.broadcast(lexicon), "word", "left").filter(F.col("given").isNotNull() | ~F.col("word").rlike(f"^(?:{JOINED}){{2,}}$"))
    rest = lexicon.join(hosts, "word", "left_anti").select("word", F.lit(0).cast("bigint").alias("n"), "given")
    every = every.select("word", "n", F.coalesce("given", F.lit(False)).alias("given")).unionByName(rest)
    total = (every.agg(F.sum("n")).first()[0] or 0) + WORD_COUNT * len(LEXICON)
    n = F.greatest(F.col("n"), F.lit(1))
    spelled = F.log(n / total) + (UNKNOWN + PER_LETTER * F.length("word")) / n
    return materialize(every.select("word", F.when(F.col("given"), F.log((WORD_COUNT + F.col("n")) / total)).otherwise(spelled).alias("log_prob")))


def _substrings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, word) of every substring of a name of 2 to LONGEST letters, and of the whole name."""
    for batch in batches:
        for number, name in zip(batch["id"].tolist(), batch["name"].tolist()):
            for at in range(0, len(name), 4096):
                found = {name[i:j] for i in range(at, min(at + 4096, len(name))) for j in range(i + 2, min(i + LONGEST, len(name)) + 1)}
                yield pd.DataFrame({"id": number, "word": pd.Series(list(found), dtype=object)})
            if len(name) > LONGEST:
                yield pd.DataFrame({"id": number, "word": pd.Series([name], dtype=object)})


@F.pandas_udf(ArrayType(StringType()))
def _split(names: pd.Series, words: pd.Series, probs: pd.Series) -> pd.Series:
    out = []
    for name, known, prob in zip(names, words, probs):
        out.append(Segmenter({} if known is None else dict(zip(known, prob))).split(name))
    return pd.Series(out, dtype=object)


def split_names(parts: DataFrame) -> DataFrame:
    """name, words: every distinct name of `parts` (host, name), split; written once."""
    names = parts.select("name").distinct().withColumn("id", F.xxhash64("name"))
    met = names.select("id", "name").mapInPandas(_substrings, "id long, word string").join(table_words(parts), "word")
    # names whose ids agree share their words, which are words all the same
    found = met.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("word", "log_prob"))).alias("w"))
    found = names.join(found, "id", "left").select("name", F.col("w.word").alias("known"), F.col("w.log_prob").alias("prob"))
    return materialize(found.select("name", _split("name", "known", "prob").alias("words")))


def url_parts(urls: DataFrame) -> DataFrame:
    """host, path, name: the runs of letters of a URL's host, without its last label, and path."""
    own = F.regexp_replace("host", "(?s)\\.[^.]*$", "")
    names = F.regexp_extract_all(F.concat_ws(" ", own, F.lower("path")), F.lit(LETTERS), 0)
    return urls.select("host", "path", F.explode(names).alias("name"))


def word_odds(urls: DataFrame, words: DataFrame) -> tuple[DataFrame, float]:
    """(word and odds, the prior) from labelled URLs (host, path, verdict, null: none) and the words of each (host, path, word)."""
    bad = words.filter(F.col("word").isin(BLOCKED_WORDS)).select("host", "path").distinct().withColumn("bad", F.lit(True))
    labelled = urls.join(bad, ["host", "path"], "left").select("host", "path", F.when(F.col("bad"), "block").otherwise(F.col("verdict")).alias("label"))
    labelled = materialize(labelled.filter("label is not null"))
    sizes = {r["label"]: r["n"] for r in labelled.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    seeds = [(w, SEED, 0.0) for w in sorted(set(BLOCKED_WORDS))]
    seeds = urls.sparkSession.createDataFrame(seeds, "word string, b double, a double")
    seen = words.join(labelled, ["host", "path"]).groupBy("word").agg(
        F.count_if(F.col("label") == "block").cast("double").alias("b"), F.count_if(F.col("label") == "allow").cast("double").alias("a")
    )
    seen = materialize(seen)
    b, a = (x or 0.0 for x in seen.agg(F.sum("b"), F.sum("a")).first())
    share = min(0.95, max(0.05, (b + 1) / (a + b + 2)))  # of the average word, without the seeds
    counts = seen.unionByName(seeds).groupBy("word").agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    odds = F.log((F.col("b") + STRENGTH * share) / (F.col("a") + STRENGTH * (1 - share))) - float(np.log(share / (1 - share)))
    prior = float(np.log((sizes.get("block", 0) + 1) / (sizes.get("allow", 0) + 1)))
    return counts.select("word", odds.alias("odds")), min(prior, 0.0)


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log-odds of block less CAUTION) of every row.

    Null and malformed urls have empty host and path, no rule and the verdict of the prior,
    which allows. Repeated rows stay rows and count once in training. Other columns are ignored.
    """
    rows = pages.select("page_id", host_of(F.col("url").cast("string")).alias("host"), path_of(F.col("url").cast("string")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = materialize(rows.select("host", "path").distinct())
    parts = url_parts(known)
    told = {w for _, text in rules for w in regex.findall(LETTERS, text.lower())} | set(PLAIN_WORDS)
    told -= set(BLOCKED_WORDS)
    names = split_names(parts)
    words = parts.join(names, "name").select("host", "path", F.explode("words").alias("word"))
    words = materialize(words.filter(~F.col("word").isin(sorted(told))))
    odds, prior = word_odds(known.withColumn("verdict", verdict), words)
    sums = words.join(odds, "word").groupBy("host", "path").agg(F.sum("odds").alias("sum"))
    rows = rows.join(sums, ["host", "path"], "left").withColumn("score", F.round(F.coalesce("sum", F.lit(0.0)) + F.lit(prior - CAUTION), 9))
    return rows.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score",
    )
