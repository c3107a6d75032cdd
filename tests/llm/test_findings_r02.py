"""Tests of the findings of round 2."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa


# op5
class Counting(dict):
    """Matches that count how often they are asked."""

    asked = 0

    def get(self, *args):
        self.asked += 1
        return super().get(*args)


def test_few_fingerprints_are_held_against_matches():
    """A text of many fingerprints with one match asks for few of them, and is cut as before."""
    from signalframe.llm import lines
    from signalframe.llm.common import WordHash

    r, hasher = random.Random(51), WordHash()
    passage = " ".join(f"p{r.randrange(10**6)}" for _ in range(60))
    some = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    earlier, later = f"{some(50)} {passage} {some(50)}".encode(), f"{some(3000)} {passage} {some(3000)}".encode()
    words = lines.Words([earlier], hasher)
    first, value = words.fingerprints(16, 11)
    matches = Counting(zip(value.view(np.int64).tolist(), (m.tobytes() for m in words.margins(first, 16, 10)), strict=True))
    n = len(lines.Words([later], hasher).fingerprints(16, 11)[0])
    ((text, _, runs, deleted),) = lines.cut_repeats([later], [matches], 16, 11, 30, hasher)
    assert (runs, deleted) == (1, 60) and len(text.split()) == 6000
    assert matches.asked < n / 10


def test_fingerprints_and_leaders_with_equal_grams():
    """Held against a plain version, on texts that repeat few words, for windows of every kind."""
    from signalframe.llm import lines
    from signalframe.llm.common import WordHash

    r, hasher = random.Random(53), WordHash()
    texts = [" ".join(r.choice("abc") for _ in range(n)).encode() for n in (0, 1, 2, 3, 5, 9, 40, 300)] + [None, b"a " * 50]
    words = lines.Words(texts, hasher)
    for gram, window in ((1, 1), (2, 3), (3, 4), (3, 11), (5, 8)):
        key, want = words.grams(gram), []
        for t in range(len(texts)):
            own = [(int(key[i]), i) for i in range(words.offset[t], words.offset[t + 1]) if key[i] != 2**64 - 1]
            spans = [own[i : i + window] for i in range(max(1, len(own) - window + 1))] if own else []
            want += sorted({min(s)[1] for s in spans})
        first, value = words.fingerprints(gram, window)
        assert first.tolist() == want and (value == key[first]).all()
        seen: dict[tuple, int] = {}
        text = words.text[first]
        assert lines._leaders(text, value).tolist() == [seen.setdefault(x, i) for i, x in enumerate(zip(text.tolist(), value.tolist(), strict=True))]


def test_matches_by_gram():
    from signalframe.llm import lines

    kind = pa.list_(pa.struct([("gram", pa.int64()), ("margins", pa.binary())]))
    rows = [[{"gram": 9, "margins": b"z"}], None, [{"gram": 1, "margins": b"a"}, {"gram": -2, "margins": b"b"}], [], None, [{"gram": 3, "margins": b"c"}]]
    assert lines._by_gram(pa.array(rows, kind).slice(1)) == [None, {1: b"a", -2: b"b"}, {}, None, {3: b"c"}]


# pipeline: memory of bpe_ids
def test_slices_are_cut_in_pieces():
    """What is made of the bytes of a slice takes a few times their room, and the words are those of the texts cut one by one."""
    import tracemalloc

    from signalframe.llm.bpe import SliceWords
    from signalframe.llm.common import WordHash

    r, hasher = random.Random(57), WordHash()
    texts = ["".join(r.choice((" some", " words", "\n", "  of", " it", " né", "<|endoftext|>")) for _ in range(n)).encode() for n in [*r.choices(range(4000), k=400), 0, 150_000]]
    SliceWords(texts[:1], None, hasher)  # what is loaded once doesn't count
    tracemalloc.start()
    words = SliceWords(texts, b"<|endoftext|>", hasher)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 11.5 * sum(map(len, texts))
    for i in (0, 1, 57, 399, 400, 401):
        alone = SliceWords([texts[i]], b"<|endoftext|>", hasher)
        lo, hi = words.offset[i : i + 2].tolist()
        cut = lambda w, lo, hi: [w.buf[a : a + n].tobytes() for a, n in zip(w.start[lo:hi].tolist(), w.size[lo:hi].tolist(), strict=True)]
        assert cut(words, lo, hi) == cut(alone, 0, None) and b"".join(cut(words, lo, hi)) == texts[i]
        assert (words.known[words.local[lo:hi]] == alone.known[alone.local]).all()


def test_the_library_gets_few_words_at_a_time(monkeypatch):
    from signalframe.llm import pretokens

    path, asked = pretokens.default_path(), []
    words = [f"{' ' * (i % 3 > 0)}w{i * 7919}" for i in range(20_000)]
    real = pretokens.tokenizer(path, True)
    want = [real.encode(w, add_special_tokens=False).ids for w in words[::997]]

    class Recorded:
        def encode_batch_fast(self, texts, **kw):
            asked.append(sum(map(len, texts)))
            return real.encode_batch_fast(texts, **kw)

    pretokens.piece_table(path)
    monkeypatch.setattr(pretokens, "tokenizer", lambda *_: Recorded())
    n, ids = pretokens.encode_words(words, path)
    start = np.cumsum(n) - n
    assert [ids[start[i] : start[i] + n[i]].tolist() for i in range(0, len(words), 997)] == want
    assert max(asked) < sum(map(len, words)) / 3
