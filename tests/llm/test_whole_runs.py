"""Line dedup against a brute force of maximal equal runs."""

import random

from terseframe.llm import line_windows

rnd = random.Random(17)


def brute_runs(texts, w):
    rows = [[(d, i, x.strip()) for i, x in enumerate(t.split("\n")) if x.split()] for d, t in enumerate(texts)]
    gone = set()
    for q, later in enumerate(rows):
        for p, before in enumerate(rows[: q + 1]):
            for shift in range(1 - len(before), len(later)):
                run = []
                for j, (_, _, line) in enumerate(later):
                    i = j - shift
                    same = 0 <= i < len(before) and (p, i) < (q, j) and before[i][2] == line
                    if same:
                        run.append(later[j])
                    if not same or j == len(later) - 1:
                        if sum(len(x.split()) for _, _, x in run) >= w:
                            gone |= {(q, i) for i in range(run[0][1], run[-1][1] + 1)}  # blank lines between go too
                        run = []
    return ["\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t in enumerate(texts)]


def test_tail_of_a_passage_goes(spark):
    passage = [" ".join(f"a{i}" for i in range(50))] + [f"b{i} c d e" for i in range(6)]
    texts = ["\n".join([*passage, "one end " * 30]), "\n".join(["start", *passage, "other end " * 30])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_windows.drop_repeats(df).collect()}
    assert got == {0: texts[0], 1: "start\n" + "other end " * 30}


def test_maximal_equal_runs(spark):
    pool = [" ".join(f"w{rnd.randrange(900)}" for _ in range(rnd.randrange(1, 9))) for _ in range(25)]
    texts = ["\n".join(rnd.choice(["", *pool]) for _ in range(rnd.randrange(1, 30))) for _ in range(60)]
    texts += ["\n".join(rnd.choice(texts).split("\n")[2:] + ["end"]) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_windows.drop_repeats(df, 10).collect()}
    assert [got[i] for i in range(len(texts))] == brute_runs(texts, 10)


def test_rows_that_repeat_a_doc_id(spark):
    p, q = (" ".join(f"{c}{i}" for i in range(80)) for c in "pq")
    rows = [(1, p), (2, p), (2, q), (2, "one line"), (2, p), (3, q)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(tuple(r)[:2] for r in line_windows.drop_repeats(df).collect())
    assert got == sorted([(1, p), (2, ""), (2, q), (2, "one line"), (2, ""), (3, "")])
    assert sorted(tuple(r) for r in line_windows.deduplicated(df.withColumn("n_chars", line_windows.F.length("text").cast("long"))).collect()) == sorted(
        [(1, p, len(p)), (2, q, len(q)), (2, "one line", 8)]
    )
