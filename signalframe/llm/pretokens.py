"""Cutting a text into words that a byte-level BPE encodes one by one.

A word is an optional blank and a run of other characters, or a run of white
space up to the blank that belongs to the next word.  The pre-tokenizer's own
pattern never matches across these cuts, so the ids of the words, in order, are
the ids of the text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
SPECIAL = "<|endoftext|>"
AT_ONCE = 4096


def split_words(text: str | None, special: str | None = SPECIAL) -> list[str]:
    """The words of a text; ``special`` is cut out first, as the library does (None: it is ordinary text)."""
    if not text:
        return []
    if special is None or special not in text:
        return WORD.findall(text)
    out: list[str] = []
    for i, part in enumerate(text.split(special)):
        if i:
            out.append(special)
        out += WORD.findall(part)
    return out


def white_bytes(buf: np.ndarray) -> np.ndarray:
    """For each byte of a UTF-8 text, whether its character is white space."""
    out = (buf == 0x20) | ((buf >= 9) & (buf <= 13))
    # The UTF-8 forms of U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
    at = np.flatnonzero(buf == 0xC2)
    at = at[at + 1 < len(buf)]
    at = at[(buf[at + 1] == 0x85) | (buf[at + 1] == 0xA0)]
    out[at] = out[at + 1] = True
    at = np.flatnonzero((buf >= 0xE1) & (buf <= 0xE3))
    at = at[at + 2 < len(buf)]
    form = buf[at].astype(np.int32) << 16 | buf[at + 1].astype(np.int32) << 8 | buf[at + 2]
    at = at[np.isin(form, [0xE19A80, *range(0xE28080, 0xE2808B), 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])]
    out[at] = out[at + 1] = out[at + 2] = True
    return out


def cut_bytes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some texts with a line break after each, and start, end and text of each of their words.

    The cuts are those of ``split_words`` without a special, but for runs of
    white space, which stay whole.
    """
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if not len(buf):
        return buf, *(np.empty(0, np.int64),) * 3
    size = np.array([len(t) for t in texts], np.int64)
    first = np.cumsum(size + 1) - size - 1
    white = white_bytes(buf)
    cut = np.zeros(len(buf), bool)
    # before a blank that belongs to a word, where another run of white space begins, and after one that doesn't end in a blank
    ahead = np.append(~white[1:], False)
    own_blank = (buf == 0x20) & ahead
    cut[1:] = own_blank[1:] | (white[1:] & ~white[:-1]) | (~white[1:] & white[:-1] & (buf[:-1] != 0x20))
    cut[first] = True
    cut[first + size] = False
    start = np.flatnonzero(cut)
    text = np.searchsorted(first, start, "right") - 1
    end = np.minimum(np.append(start[1:], len(buf)), (first + size)[text])
    return buf, start, end, text


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(4)
def tokenizer(path: str, special: bool = True):
    """The tokenizer of a file, one for each worker; with ``special`` false its special strings are ordinary text."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    out.encode_special_tokens = not special
    return out


def encode_words(words: list[str], path: str, special: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The number of ids of each word, and the ids of all.

    Words that begin with a blank and go on with something else are encoded some
    hundred at a time, side by side: no token reaches over such a blank.  The bytes
    of the tokens tell which belong to a word.  The library gets ``AT_ONCE`` words
    at a time, as what it returns takes many times the room of the ids.
    """
    fast = tokenizer(path, special).encode_batch_fast
    sizes, ids = np.zeros(len(words), np.int64), [np.empty(0, np.int32)] * len(words)
    joined = [i for i, w in enumerate(words) if len(w) > 1 and w[0] == " " and not w[1].isspace()]
    there = set(joined)
    alone = [i for i in range(len(words)) if i not in there]
    for own in (alone[i : i + AT_ONCE] for i in range(0, len(alone), AT_ONCE)):
        for i, e in zip(own, fast([words[i] for i in own], add_special_tokens=False), strict=True):
            ids[i] = np.array(e.ids, np.int32)
            sizes[i] = len(ids[i])
    runs = [joined[i : i + 256] for i in range(0, len(joined), 256)]
    length = piece_table(path)[1]
    order = [np.array(alone, np.int64)]
    flat = [np.concatenate([np.empty(0, np.int32), *(ids[i] for i in alone)])]
    for some in (runs[i : i + AT_ONCE // 256] for i in range(0, len(runs), AT_ONCE // 256)):
        for run, e in zip(some, fast(["".join([words[i] for i in run]) for run in some], add_special_tokens=False), strict=True):
            own = np.array(e.ids, np.int32)
            ends = np.cumsum([len(words[i].encode()) for i in run])
            sizes[run] = np.diff(np.searchsorted(np.cumsum(length[own]), ends, "right"), prepend=0)
            order.append(np.array(run, np.int64))
            flat.append(own)
    every, flat = np.concatenate(order), np.concatenate(flat)
    n = sizes[every]
    start = np.empty(len(words), np.int64)
    start[every] = np.cumsum(n) - n
    return sizes, gathered(flat, start, sizes)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start : start + size] of each pair, one after the other."""
    ends = np.cumsum(size)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(start - (ends - size), size)]


@functools.lru_cache(4)
def piece_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of the bytes of each id, and all those bytes."""
    table = pieces(path)
    length = np.array([len(x) for x in table], np.int64)
    return np.cumsum(length) - length, length, np.frombuffer(b"".join(table), np.uint8)


def decode_ids(ids: np.ndarray, path: str) -> bytes:
    """The bytes of some ids: each id joined with its piece."""
    start, length, flat = piece_table(path)
    return gathered(flat, start[ids], length[ids]).tobytes()


def pieces(path: str) -> list[bytes]:
    """The bytes of each id, by id: a table as long as the vocabulary."""
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    t = tokenizer(path)
    size = t.get_vocab_size(with_added_tokens=True)
    out = []
    for i in range(size):
        piece = t.id_to_token(i) or ""
        out.append(bytes(byte_of[c] for c in piece) if all(c in byte_of for c in piece) else piece.encode())
    return out
