"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from terseframe.llm import byte_bpe

SCHEMA = "doc_id long, text string, found_ids string, found_bytes int"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tokenizer():
    return byte_bpe.load_tokenizer(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(tokenizer):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=tokenizer.tokens, special_tokens={})


def expected(library, rows):
    out = []
    for i, text in rows:
        ids = library.encode_ordinary(text or "")
        sha = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        out.append((str(i), len(ids), sha, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), *tuple(r)[1:]) for r in df.collect())


def test_given_texts(spark, sf, tokenizer, library):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert got(byte_bpe.digests(df, tokenizer)) == expected(library, rows)


def test_odd_texts(spark, tokenizer, library):
    rnd = random.Random(4)
    letters = "aaabehinorst 012'.,\n\t ßéłö漢字한🙂\x1c\x85  ᠎​Ія<|>"
    texts = [None, "", " ", "  \n ", "a", "I'll they've 'S can't", "<|endoftext|>", "a" * 3000, "ab" * 1500, "th" * 900 + "e" * 901, "\x00\x01", "x" * 31 + " " * 40]
    texts += ["".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 400))) for _ in range(300)]
    texts += ["".join(rnd.choice("eithnaors") for _ in range(2500)), "word and more, " * 90_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, "word"), (3, "word"), (None, "word")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    assert got(byte_bpe.digests(df, tokenizer)) == expected(library, rows)
    assert byte_bpe.digests(df.filter("false"), tokenizer).count() == 0


def test_general_form_and_slices(spark, tokenizer, library, monkeypatch):
    engine = byte_bpe.Engine(tokenizer)
    for name in ("GROUP_BYTES", "GROUP_IDS", "LONG_TEXT"):
        monkeypatch.setattr(byte_bpe, name, 7)
    texts = ["some strange wrds inn a row", "", "unglaublich", "some strange wrds inn a row"]
    sizes, ids = engine.encode(texts)
    want = [library.encode_ordinary(t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    assert engine.decode(sizes, ids) == [t.encode() for t in texts]
    with pytest.raises(ValueError):
        engine.decode(sizes[:1] * 0 + 1, ids[:1] * 0 + 10**6)
    df = spark.createDataFrame([(1, "Hello  world", "x", 1)], SCHEMA)
    out = byte_bpe.decode(byte_bpe.encode(df, tokenizer), tokenizer, "found_ids_").collect()[0]
    assert out["found_ids_"] == library.encode_ordinary("Hello  world") and bytes(out["found_bytes_"]) == b"Hello  world"


def test_any_merge_table(tokenizer):
    """A rank file whose tokens were not learnt by merging: ranks at random."""
    rnd = random.Random(2)
    tokens = [bytes([i]) for i in range(256)] + list({"".join(rnd.choice("abc") for _ in range(rnd.randrange(2, 6))).encode() for _ in range(150)})
    order = tokens[:256] + rnd.sample(tokens[256:], len(tokens) - 256)
    import base64

    own = byte_bpe.Tokenizer.of([base64.b64encode(t) + b" %d" % i for i, t in enumerate(order)], r"\S+|\s+")
    library = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=own.tokens, special_tokens={})
    texts = ["".join(rnd.choice("abc ") for _ in range(rnd.randrange(1, 90))) for _ in range(400)]
    sizes, ids = byte_bpe.Engine(own).encode(texts)
    assert ids.tolist() == [i for t in texts for i in library.encode_ordinary(t)] and not own.merges[3].all()
