"""Tests of what the review of round 1 found missing."""

import random

from .conftest import ODD, frame, words


def test_near_duplicates_by_five_words_at_four_fifths(spark):
    import corpus_pipeline as pipeline

    r = random.Random(23)
    docs = []
    for size in (5, 9, 14, 30, 80, 200):
        base = words(r, size)
        for _ in range(9):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                w[r.randrange(len(w))] = "z" + str(r.randrange(99))
            docs.append(" ".join(w[: len(w) - r.choice([0, 0, 1, 4])]))
    r.shuffle(docs)
    docs += ODD

    def sets(size):
        out = []
        for t in docs:
            w = (t or "").encode().lower().split()
            out.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set())
        return out

    def kept(size, num, den):
        own, top = sets(size), list(range(len(docs)))
        for i in range(len(docs)):
            for j in range(i):
                if own[i] and den * len(own[i] & own[j]) >= num * len(own[i] | own[j]):
                    a, b = sorted((top[i], top[j]))
                    top = [a if x == b else x for x in top]
        return {i for i, x in enumerate(top) if i == x}

    got = {x.doc_id for x in pipeline.near_duplicates(spark, frame(spark, docs), "").collect()}
    assert got == kept(5, 4, 5) != kept(3, 9, 10)


def test_schemes_meet_at_four_fifths():
    import numpy as np

    from signalframe.llm import jaccard

    bands, r = jaccard.Bands(4, 5), np.random.default_rng(5)
    for _ in range(300):
        n = int(r.integers(2, 300))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        gone, new = int(r.integers(0, n // 8 + 1)), int(r.integers(0, n // 8 + 1))
        b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, new, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        common = len(np.intersect1d(a, b))
        if 5 * common >= 4 * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            assert len(np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands))), (len(a), len(b), common)


def test_passages_of_51_words_anywhere_are_cut(spark):
    """Shared passages that begin and end inside sentences, by brute force over words."""
    from signalframe.llm import lines

    r = random.Random(31)

    def sentences(n, least):
        w = [f"w{r.randrange(10**6)}" for _ in range(n)]
        i = 0
        while (i := i + r.randint(least, 3 * least)) < n:
            w[i - 1] += "."
        return w

    docs, passages = [], []
    for k in range(40):
        p = sentences(51, r.choice([3, 12, 40]))
        passages.append(p)
        docs.append([*sentences(r.randint(0, 60), 10), *p, *sentences(r.randint(0, 60), 10)])
    for p in passages:
        docs.append([*sentences(r.randint(1, 60), 10), *p, *sentences(r.randint(1, 60), 10)])
    got = {x.doc_id: x for x in lines.dedup_lines(frame(spark, [" ".join(d) for d in docs]), report=True).collect()}
    for i, d in enumerate(docs):
        want = d if i < 40 else [w for w in d if w not in set(passages[i - 40])]
        assert got[i].text.split() == want and got[i].n_words == len(d) - len(want)


def test_ends_of_a_passage_of_short_lines_go(spark):
    """One word a line: 51 lines in two texts that differ otherwise go whole."""
    from signalframe.llm import lines

    r = random.Random(37)
    some = lambda n: [f"v{r.randrange(10**6)}" for _ in range(n)]
    passages = [some(51) for _ in range(40)]
    docs = [some(40) + p + some(40) for p in passages] + [some(40) + p + some(40) for p in passages]
    got = {x.doc_id: x for x in lines.dedup_lines(frame(spark, ["\n".join(d) for d in docs]), report=True).collect()}
    for i, d in enumerate(docs):
        assert got[i].text.split() == (d if i < 40 else d[:40] + d[-40:]) and got[i].n_lines == 131


def test_favoured_classes_are_the_likeliest():
    import math

    import numpy as np

    from signalframe.llm import brown

    r = np.random.default_rng(3)
    m, own = r.poisson(0.7, (30, 30)), r.integers(0, 4, 30)
    after, before, n = np.zeros((30, 4), np.int64), np.zeros((30, 4), np.int64), np.zeros((4, 4))
    for c in range(4):
        after[:, c], before[:, c] = m[:, own == c].sum(1), m[own == c].sum(0)
    np.add.at(n, own, after)
    got = brown.favoured(after, before, own, n)
    for u in range(30):
        value = []
        for c in range(4):
            row, column = n[c].copy(), n[:, c].copy()
            if c == own[u]:
                row, column = row - after[u], column - before[u]
            value.append(sum(after[u, d] * math.log((row[d] + 1) / (row.sum() + 4)) + before[u, d] * math.log((column[d] + 1) / (column.sum() + 4)) for d in range(4)))
        assert value[got[u]] > max(value) - 1e-6


def test_words_past_the_head_are_classed_by_their_transitions(spark):
    """Two kinds of rare words alternate; the head is of two words, endings tell nothing."""
    from pyspark.sql import functions as F

    from signalframe.llm import brown

    r = random.Random(41)
    a, b = [f"a{i}xyz" for i in range(60)], [f"b{i}xyz" for i in range(60)]
    docs = [" ".join(r.choice((a, b)[j % 2]) for j in range(40)) for _ in range(120)]
    df = frame(spark, docs).withColumn("training", F.col("doc_id") % 4 != 0)
    got = brown.fit_and_score(df, "training", units=2, tails=8, classes=3, rounds=4).collect()
    held = [x for x in got if x.doc_id % 4 == 0]
    # knowing the kind of each word is worth about log10(2) a word
    assert sum(x.score - x.base_score for x in held) > 0.2 * sum(x.n_tokens for x in held)


def test_items_without_an_id_are_hit(spark):
    from signalframe.llm import decontaminate

    passage = " ".join(f"q{i}" for i in range(12))
    docs, items = frame(spark, [f"before {passage} after", "clean text"]), spark.createDataFrame([(None, passage)], "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.find_hits(docs, items, 10).collect()}
    assert (got[0].n_hit, got[0].item_ids, got[1].n_hit) == (12, [], 0)
    assert [x.doc_id for x in decontaminate.remove_contaminated(docs, items).collect()] == [1]


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """Of a passage in two rows of one id and in one of another, the first row's stays; null ids come before all."""
    from signalframe.llm import lines

    passage = " ".join(f"u{i}" for i in range(80))
    rows = [(1, passage), (1, passage), (2, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(x.n_words for x in lines.dedup_lines(df, report=True).collect()) == [0, 80, 80]
    df = spark.createDataFrame([*rows, (None, passage), (None, passage)], "doc_id long, text string").coalesce(1)
    got = lines.dedup_lines(df, report=True).collect()
    assert sorted((x.doc_id or 0, x.n_words) for x in got) == [(0, 0), (0, 80), (1, 80), (1, 80), (2, 80)]


def test_hits_are_the_same_for_any_block_size(spark):
    from signalframe.llm import decontaminate

    r = random.Random(3)
    items = [" ".join(words(r, r.choice([3, 9, 10, 15]))) for _ in range(12)]
    texts = [" ".join(words(r, 5)) + " " + r.choice(items) + " " + " ".join(words(r, 7)) for _ in range(20)] + ODD
    docs = frame(spark, texts).selectExpr("doc_id div 2 as doc_id", "text")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = [sorted(map(str, decontaminate.find_hits(docs, bench, 10, block_bytes=b).collect())) for b in (1 << 20, 200, 64)]
    assert got[0] == got[1] == got[2] and len(got[0]) == len(texts) and any("Row(first" in x for x in got[0])
