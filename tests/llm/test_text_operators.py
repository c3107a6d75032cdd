import collections
import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from signalframe.llm import bpe, brown, counts, decontaminate, jaccard, langid, lines, media, quality, urls

from .conftest import ODD, frame, prose, words


@pytest.fixture(scope="module")
def texts(rng):
    return [prose(rng, rng.randint(1, 120)) for _ in range(30)] + ODD


# op1
def test_language_model_counts_and_learns(spark, rng):
    vocabulary = {lang: words(rng, 40, lang) for lang in ("en", "fr")}
    docs = [" ".join(rng.choices(vocabulary[rng.choice(["en", "fr"])], k=60)) for _ in range(60)] + ODD
    df = frame(spark, docs).withColumn("training", F.col("doc_id") % 3 != 0)
    got = {r.doc_id: r for r in brown.fit_and_score(df, "training", units=50, tails=8, classes=6, rounds=3).collect()}
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    c = collections.Counter(w for i, t in enumerate(docs) if i % 3 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(docs):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t))
        assert got[i].n_tokens == len(tokens(t)) and got[i].n_known == sum(c[w] > 0 for w in tokens(t)) and got[i].train_tokens == n
        assert got[i].base_score == pytest.approx(base) and math.isfinite(got[i].score)
    held = [got[i] for i in range(0, 60, 3)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_exchange_raises_the_likelihood():
    import numpy as np

    r = np.random.default_rng(1)
    n = r.poisson(np.kron(np.array([[9, 1], [1, 9]]), np.ones((10, 10))))
    classes = np.arange(20) % 2

    def count(k):
        after, before = np.zeros((20, 2)), np.zeros((20, 2))
        for c in range(2):
            after[:, c], before[:, c] = n[:, k == c].sum(1), n[k == c].sum(0)
        return after, before, n.diagonal()

    def value(k):
        m = np.zeros((2, 2))
        np.add.at(m, k, count(k)[0])
        return brown.likelihood(m)

    for u in range(20):  # one unit at a time, its best class is the best of all
        new = brown.exchange(*count(classes), classes, np.array([u]))
        assert value(new) == pytest.approx(max(value(np.where(np.arange(20) == u, c, classes)) for c in range(2)))
        classes = new
    assert set(classes[:10].tolist()) != set(classes[10:].tolist())


# op2
def test_bpe_round_trip(spark, texts):
    from tokenizers import Tokenizer

    from signalframe.llm.pretokens import default_path

    t = Tokenizer.from_file(default_path())
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(frame(spark, texts).select("doc_id", "text"))).collect()}
    for i, text in enumerate(texts):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].text == t.decode(ids, skip_special_tokens=False)


# op3
def test_language_is_told(spark, rng):
    known = [(prose(rng, 40, lang), lang) for lang in ("en", "fr", "de") for _ in range(20)]
    df = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(known)], "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 2 = 0"))
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, (_, lang) in enumerate(known))
    odd = {r.doc_id: r.lang_pred for r in langid.predict(frame(spark, ODD), model).collect()}
    assert [odd[i] for i in range(4)] == ["und"] * 4 and odd[8] != "und"
    nothing = langid.fit(df.where("false"))
    assert {r.lang_pred for r in langid.predict(df, nothing).collect()} == {"und"}
    assert langid.accepted(frame(spark, ODD), model).count() == 6


# op4
def test_counts_follow_edits(spark):
    from tokenizers import Tokenizer

    from signalframe.llm.pretokens import default_path, split_words

    t, r, counter = Tokenizer.from_file(default_path()), random.Random(3), counts.Counter(default_path())
    t.encode_special_tokens = True
    some = lambda n: "".join(r.choice(["the", " ", "  ", "\n", "ab", "Word's", "12", ".", "é", "\t", "<|endoftext|>"]) for _ in range(n))
    for _ in range(150):
        text = some(r.choice([0, 1, 3, 40, 600]))
        tree = counts.CountTree(text, counter)
        for _ in range(5):
            at, length, new = r.randint(-2, len(text) + 3), r.choice([0, 1, 3, 10, 1000]), some(r.choice([0, 1, 5, 300]))
            place = min(max(0, at), len(text))
            text = text[:place] + new + text[place + length :]
            tree.edit(at, length, new)
            assert [w for b in tree.words for w in b] == split_words(text, None) and tree.total == len(t.encode(text, add_special_tokens=False).ids)
    tree = counts.CountTree("word " * 10_000, counter)
    tree.edit(25_000, 3, "x")
    assert tree.recoded < 10
    edits = spark.createDataFrame([(5, 1, 0, 4, "other"), (5, 0, 0, 0, "A "), (0, 0, 3, None, "new"), (9, 0, None, 1, "x")], "doc_id long, seq int, start int, length int, new string")
    got = {x.doc_id: x for x in counts.recount(counts.attach_edits(frame(spark, ODD), edits)).collect()}
    assert got[0].n_tokens == 0 and got[0].n_chars_after == 3 and got[5].n_edits == 2 and got[9].n_edits == 0


# op5
def test_later_repeats_go(spark, rng):
    passage = prose(rng, 70)
    docs = [prose(rng, 60) for _ in range(12)]
    docs[3] += "\n" + passage
    for i in (5, 8):
        docs[i] = docs[i] + " " + passage + "\n" + prose(rng, 30)
    docs += [docs[0], "One. " * 3, *ODD]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, docs), report=True).collect()}
    assert [i for i in range(12) if got[i].n_runs] == [5, 8] and got[12].n_words == 60 and got[12].text.strip() == ""
    core = " ".join(passage.split()[16:-16])
    assert [i for i in range(12) if core in " ".join(got[i].text.split())] == [3]
    for i, t in enumerate(docs):
        if not got[i].n_runs:
            assert got[i].text == t
    kept = lines.dedup_lines(frame(spark, docs))
    assert kept.columns == frame(spark, docs).columns and kept.count() == len(docs)


def test_cut_is_never_of_text_met_first(spark, rng):
    """Whatever is deleted stands, sentence by sentence, in an earlier document or earlier in its own."""
    pool = [prose(rng, 25) for _ in range(8)]
    docs = ["\n".join(rng.choices(pool, k=rng.randint(1, 5)) + [prose(rng, 10)]) for _ in range(40)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(frame(spark, docs), report=True).collect()}
    cut = lambda t: [s for s in t.replace(".\n", ". ").split(". ") if s.strip()]
    before = set()
    for i, t in enumerate(docs):
        gone = collections.Counter(s.strip(". \n") for s in cut(t)) - collections.Counter(s.strip(". \n") for s in cut(got[i]))
        own = collections.Counter(s.strip(". \n") for s in cut(t))
        assert all(s in before or own[s] > k for s, k in gone.items())
        before |= set(own)


# op6
def test_media_round_trip(spark, texts):
    got = {r.doc_id: r for r in media.read_back(media.store(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        size = max(192, -(-len(data) // 192) * 192)
        assert bytes(got[i].payload) == data + b" " * (size - len(data)) and got[i].n_bytes == len(data)
    assert got[30 + 5].feature == got[30 + 6].feature
    tall = b"ab" * 96 * 20_000  # more rows than an image may have
    assert media.to_pixels(media.to_media(tall)).tobytes() == tall


# op7
def test_url_rules(spark):
    r = random.Random(5)
    host = lambda: ".".join(r.choice(["a", "b", "c", "org", "B"]) for _ in range(r.randint(1, 4)))
    pages = [f"http://{host()}{r.choice(['', '/', '/x', '/x/y', '/xy?q=/x', '#/x'])}" for _ in range(300)] + [None, "", "no scheme", "://", "http://a.org:80/x"]
    rules = list({(host().lower(), r.choice(["", "/", "/x", "/x/"])): r.choice(["allow", "block"]) for _ in range(40)}.items())
    df = spark.createDataFrame(list(enumerate(pages)), "page_id long, url string")
    table = spark.createDataFrame([(h, p, v) for (h, p), v in rules] + [(None, "/", "block")], "host string, path string, verdict string")
    got = {x.page_id: x for x in urls.judge(df, table, ranges=7).collect()}
    for i, u in enumerate(pages):
        h, p = urls.split_url(u)
        fits = [(len(a) + len(b), len(a), a + b, v) for (a, b), v in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=None)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (h, p, best and best[2], best[3] if best else "allow"), u
    assert urls.judge(df.where("false"), table).count() == 0 and urls.judge(df, table.where("false")).where("verdict = 'block'").count() == 0


# op8
def test_benchmark_hits(spark, rng):
    items = [" ".join(words(rng, 14)) for _ in range(6)] + ["two words", "", None, "!!"]
    docs = [prose(rng, 80) for _ in range(10)]
    docs[2] += " " + items[0].upper() + "."
    docs[4] = " ".join(items[1].split()[2:13]) + " " + docs[4]
    docs[6] += " Two, WORDS again"
    docs += ODD
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    plain = lambda t: [w for w in "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (t or "").lower()).split() if w]
    for block in (16 << 20, 64):  # in one block and in many
        got = {r.doc_id: r for r in decontaminate.find_hits(frame(spark, docs), bench, block_bytes=block).collect()}
        for i, t in enumerate(docs):
            w, hit, found = plain(t), set(), set()
            for k, item in enumerate(items):
                x = plain(item)
                n = min(10, len(x))
                wins = {tuple(x[j : j + n]) for j in range(len(x) - n + 1)} if n else set()
                for j in range(len(w) - n + 1 if n else 0):
                    if tuple(w[j : j + n]) in wins:
                        hit |= set(range(j, j + n))
                        found.add(str(k))
            assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == (len(w), len(hit), sorted(found))
        assert decontaminate.remove_contaminated(frame(spark, docs), bench, block_bytes=block).count() == len(docs) - 3
    cut = decontaminate.remove_contaminated(frame(spark, docs), bench, mode="spans")
    assert decontaminate.find_hits(cut, bench).where("n_hit > 0").count() == 0 and cut.count() == len(docs)


# op9
def test_quality_is_told(spark, rng):
    good, bad = [prose(rng, 50) for _ in range(60)], [" ".join(w.upper() + "!!" for w in words(rng, 50)) for _ in range(60)]
    df = frame(spark, good + bad)
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(120)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(df, labels.where("doc_id % 2 = 0"))
    got = {r.doc_id: r.score for r in quality.score(frame(spark, good + bad + ODD), model).collect()}
    assert all((got[i] >= 0.5) == (i < 60) for i in range(120)) and all(0 <= s <= 1 for s in got.values())
    assert {r.score for r in quality.score(df, quality.fit(df, labels.where("false"))).collect()} == {0.5}


# op10
def brute_components(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))} if w else set())
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return [(len(s), top(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize("small", [16, 2])
def test_components(spark, small, monkeypatch):
    r = random.Random(11)
    docs = []
    for size in (4, 9, 12, 25, 60, 150, 300):  # families of copies with few and with many words changed
        base = words(r, size)
        for _ in range(14):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = r.choice(["neu", "x1", "y2", "z" + str(r.randrange(99))])
            docs.append(" ".join(w[: len(w) - r.choice([0, 0, 0, 1, 4])]))
    r.shuffle(docs)
    docs += ODD
    links = jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda *a, **k: links(*a, **(k | {"small": small})))  # 2: nearly all buckets are large
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.join_components(frame(spark, docs)).collect()}
    assert [got[i] for i in range(len(docs))] == brute_components(docs)


def test_schemes_meet_and_sketches_bound():
    import numpy as np

    bands, r = jaccard.Bands(), np.random.default_rng(2)
    for _ in range(300):
        n = int(r.integers(2, 400))
        a = np.unique(r.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64) * np.uint64(2))
        gone, new = int(r.integers(0, max(1, n // 15) + 1)), int(r.integers(0, max(1, n // 15) + 1))
        b = np.unique(np.concatenate([r.permutation(a)[gone:], r.integers(0, 2**63, new, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)]))
        common = len(np.intersect1d(a, b))
        if len(b) and 10 * common >= 9 * (len(a) + len(b) - common) and len(a) + len(b) > 2 * common:
            assert len(np.intersect1d(jaccard.signatures(a, bands), jaccard.signatures(b, bands))), (len(a), len(b), common)
        assert jaccard.least_difference(jaccard.sketch(a), jaccard.sketch(b)) <= len(a) + len(b) - 2 * common


def test_empty_tables(spark, empty):
    assert brown.fit_and_score(empty.withColumn("training", F.lit(True)), "training", units=5, tails=2, classes=2, rounds=1).count() == 0
    assert bpe.encode(empty.select("doc_id", "text")).count() == 0
    assert lines.dedup_lines(empty).count() == 0 and media.store(empty).count() == 0
    assert jaccard.join_components(empty).count() == 0
    assert decontaminate.find_hits(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = pipeline.run(spark, folder)
    rows = out.collect()
    assert {r.doc_id for r in rows} < {r.doc_id for r in docs.collect()} and 0.6 * docs.count() < len(rows)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() for r in rows)


def test_kept_trees_take_edits(spark):
    """Trees built once and stored; later edits encode only what they touch, and the trees kept then are right for the next ones."""
    from tokenizers import Tokenizer

    from signalframe.llm.pretokens import default_path

    t = Tokenizer.from_file(default_path())
    t.encode_special_tokens = True
    texts = ["some words here " * 400, "é\n\nx  y", "", "one", "one"]
    trees = counts.build(frame(spark, texts)).cache()
    for start, length, new in ((3000, 5, "edited  text"), (0, 0, "A "), (10_000, 3, " end")):
        edits = F.array(F.struct(F.lit(start).alias("start"), F.lit(length).alias("length"), F.lit(new).alias("new")))
        done = counts.apply_edits(trees.withColumn("edits", edits)).cache()
        texts = [x[: min(start, len(x))] + new + x[min(start, len(x)) + length :] for x in texts]
        rows = sorted(done.collect(), key=lambda r: (r.doc_id, r.text))
        assert [(r.text, r.n_tokens_after) for r in rows] == [(x, len(t.encode(x, add_special_tokens=False).ids)) for x in texts]
        assert all(r.n_recoded < 20 for r in rows), "an edit encodes what it touches"
        trees = done.select("doc_id", "text", "tree", "n_words", F.col("n_tokens_after").alias("n_tokens"))
