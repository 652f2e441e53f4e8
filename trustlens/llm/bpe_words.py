"""Words of two public BPE tokenizers, cut from whole Arrow batches, and their ids.

Texts of Latin letters and common punctuation are cut into words by the classes of their
bytes, all texts of a batch at once, and words are looked up.  Texts with other
characters (where the class of a character depends on the library's Unicode tables) are
cut by the library's own pre-tokenizer, and their words are looked up alike; but where a
tokenizer normalizes texts first (``WORD_END``) they are left whole for the library.  So
is every text with the string of a special token.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from trustlens.llm.common import ragged_take

#: Code points that are cut here: below U+0250 (but U+0130, whose lower case has two
#: characters), U+2010 to U+2027 and U+20AC.
LATIN_END = 0x250
DOTTED_I = 0x130
WHITE = {*range(9, 14), 32, 0x85, 0xA0}
BLANK, GAP, LETTER, NUMBER, OTHER = range(5)
#: After an apostrophe that begins a word: these make one word with it.
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")


def _class_of(code: int) -> int:
    if code in WHITE:
        return BLANK if code == 32 else GAP
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)


CLASSES = np.array([_class_of(c) for c in range(LATIN_END)], dtype=np.uint8)


@dataclass(frozen=True)
class WordSplit:
    """How a tokenizer cuts a text: ``glued``: words keep one blank before them, and runs
    of white space are words; else white space is dropped, numbers are cut into digits
    and letters are lower-cased."""
    glued: bool
    specials: tuple[str, ...]


BYTE_LEVEL = WordSplit(True, ("<|endoftext|>",))
WORD_END = WordSplit(False, ("<|startoftext|>", "<|endoftext|>"))


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _wide(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first bytes of two-byte characters, and their code points."""
    two = np.flatnonzero((data >= 0xC0) & (data < 0xE0))
    return two, ((data[two].astype(np.int32) & 0x1F) << 6) | (data[two + 1] & 0x3F)


def foreign_texts(texts: pa.Array) -> np.ndarray:
    """Which texts hold characters that ``cut`` has no class for."""
    data, offsets = _buffers(texts)
    two, code = _wide(data)
    three = np.flatnonzero(data >= 0xE0)
    a, b, c = data[three], data[np.minimum(three + 1, len(data) - 1)], data[np.minimum(three + 2, len(data) - 1)]
    fine = (a == 0xE2) & (((b == 0x80) & (c >= 0x90) & (c <= 0xA7)) | ((b == 0x82) & (c == 0xAC)))
    bad = np.concatenate([two[(code >= LATIN_END) | (code == DOTTED_I)], three[~fine]])
    return np.bincount(np.searchsorted(offsets[1:], bad, side="right"), minlength=len(texts))[:len(texts)] > 0


def special_texts(texts: pa.Array, how: WordSplit) -> np.ndarray:
    """Which texts hold the string of a special token."""
    out = np.zeros(len(texts), dtype=bool)
    for s in how.specials:
        out |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
    return out


def cut(texts: pa.Array, how: WordSplit) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts end to end, and the number of words of each text."""
    if not how.glued:
        texts = pc.utf8_lower(texts)
    data, offsets = _buffers(texts)
    n = len(data)
    kind = np.full(n, OTHER, dtype=np.uint8)
    ascii_ = data < 0x80
    kind[ascii_] = CLASSES[data[ascii_]]
    two, code = _wide(data)
    kind[two] = kind[two + 1] = CLASSES[code]
    first = (data & 0xC0) != 0x80
    run = np.where(kind == BLANK, GAP, kind)
    start = np.zeros(n + 1, dtype=bool)
    start[1:n] = first[1:] & (run[1:] != run[:-1])
    start[offsets] = True
    if how.glued:
        # a run after white space: its last blank goes with it, another last character stands alone
        after = np.flatnonzero(start[1:n] & (run[1:] != GAP) & (run[:-1] == GAP)) + 1
        after = after[~np.isin(after, offsets)]
        last = after - np.where(first[after - 1], 1, 2)
        start[last] = True
        start[after[kind[last] == BLANK]] = False
    else:
        start[:n][(kind == NUMBER) & first] = True
    marks = np.flatnonzero((data == 39) & start[:n])
    end = offsets[1:][np.searchsorted(offsets[1:], marks, side="right")]
    follows = lambda k: data[np.minimum(marks + k, n - 1)]
    for suffix in SUFFIXES:
        fits = marks + len(suffix) < end
        for k, ch in enumerate(suffix):
            fits = fits & (follows(k + 1) == ord(ch))
        start[marks[fits] + 1] = False
        start[marks[fits] + 1 + len(suffix)] = True
    begins = np.flatnonzero(start[:n])
    per_text = np.diff(np.searchsorted(begins, offsets))
    ends = np.append(begins, n).astype(np.int32)
    words = pa.StringArray.from_buffers(len(begins), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))
    if how.glued:
        return words, per_text
    seen = run[begins] != GAP  # white space is no word here
    before = np.concatenate([[0], np.cumsum(seen)])
    at = np.concatenate([[0], np.cumsum(per_text)])
    return words.filter(pa.array(seen)), np.diff(before[at])


def load_tokenizer(spec: str):
    """A tokenizer from its JSON text, without truncation and padding.  One thread: a
    task has one core, and every thread of the library keeps a cache of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_str(spec)
    t.no_truncation()
    t.no_padding()
    return t


WORD_TAIL = "</w>"


def word_tails(tokenizer) -> np.ndarray | None:
    """Which ids end a word, if the vocabulary marks word ends; else None."""
    vocab = tokenizer.get_vocab(with_added_tokens=False)
    tails = np.zeros(max(vocab.values()) + 1, dtype=bool)
    tails[[i for piece, i in vocab.items() if piece.endswith(WORD_TAIL)]] = True
    return tails if tails.any() else None


def encode_words(tokenizer, words: list[str], tails: np.ndarray | None = None, step: int = 1024) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers.  Words go to the
    library many at a time.  Where the vocabulary marks word ends (``tails``) they stand
    apart by a blank; else by a special token: it cuts a text there before anything
    else, and no word holds one."""
    special = "<|endoftext|>"
    mark = tokenizer.token_to_id(special)
    out: list[bytes] = []
    for a in range(0, len(words), step):
        text = " ".join(words[a:a + step]) if tails is not None else special.join(["", *words[a:a + step], ""])
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")
        raw = ids.tobytes()
        if tails is not None:
            ends = ((np.flatnonzero(tails[ids]) + 1) * 4).tolist()
            out += [raw[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True)]
        else:
            cuts = (np.flatnonzero(ids == mark) * 4).tolist()
            out += [raw[i + 4:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    if len(out) != len(words):
        raise ValueError("the library cut a word otherwise")
    return out


def encode_texts(tokenizer, texts: list[str]) -> list[bytes]:
    """The ids of whole texts, special tokens in them included."""
    return [np.array(tokenizer.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]


def _with_foreign(texts: pa.Array, foreign: np.ndarray, words: pa.Array, per_text: np.ndarray, tokenizer) -> tuple[pa.Array, np.ndarray]:
    """``cut``'s result with the words that the library cuts from the foreign texts."""
    pieces = tokenizer.pre_tokenizer.pre_tokenize_str
    lists = [[t[a:b] for _, (a, b) in pieces(t)] for t in texts.filter(pa.array(foreign)).to_pylist()]
    own = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    sizes, starts = per_text.copy(), np.cumsum(per_text) - per_text
    sizes[foreign], starts[foreign] = own, len(words) + np.cumsum(own) - own
    both = pa.concat_arrays([words, pa.array([w for ws in lists for w in ws], pa.string())])
    return both.take(pa.array(ragged_take(np.arange(len(both)), starts, sizes))), sizes


def plain_words(texts: pa.Array, how: WordSplit, tokenizer: Callable) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of the texts that are not left whole (those count as empty), the number of
    words of each text, and which texts stay whole.  ``tokenizer()`` gives the library's
    tokenizer and is called if a text needs it."""
    odd, foreign = special_texts(texts, how), foreign_texts(texts)
    if not how.glued:
        odd = odd | foreign
    foreign = foreign & ~odd
    there = texts
    if odd.any() or foreign.any():
        there = pc.if_else(pa.array(odd | foreign), pa.scalar("", texts.type), texts)
    words, per_text = cut(there, how)
    if foreign.any():
        words, per_text = _with_foreign(texts, foreign, words, per_text, tokenizer())
    return words, per_text, odd


def encode_batch(texts: pa.Array, how: WordSplit, lookup: Callable[[list[str]], list[bytes]], tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts of a batch end to end, and the number of ids of each text."""
    words, per_text, odd = plain_words(texts, how, lambda: tokenizer)
    flat = words.dictionary_encode()
    known = lookup(flat.dictionary.to_numpy(zero_copy_only=False).tolist())  # faster than to_pylist
    sizes = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
    starts = np.cumsum(sizes) - sizes
    at = flat.indices.to_numpy(zero_copy_only=False)
    own = sizes[at]
    ids = ragged_take(np.frombuffer(b"".join(known), dtype="<u4"), starts[at], own)
    ends = np.concatenate([[0], np.cumsum(own)])[np.cumsum(per_text)]
    counts = np.diff(ends, prepend=0)
    if not odd.any():
        return ids, counts
    parts = np.split(ids, ends[:-1])
    for i in np.flatnonzero(odd):
        parts[i] = np.frombuffer(encode_texts(tokenizer, [texts[int(i)].as_py()])[0], dtype="<u4")
    return np.concatenate(parts), np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
