"""Token ids of many texts by the tokenizers library, each distinct word encoded once per worker.

A tokenizer that splits text before its merges gives the same ids when the text is cut at places
where it splits anyway. ``SPACED`` tokenizers are byte-level ones that keep a space with the word
behind it: texts are cut before a single space between other characters. ``WORD`` tokenizers
lower-case words and drop white space: texts are cut at it. Words are found and hashed as arrays;
ids of known words are gathered by table. The Python worker remembers up to ``REMEMBERED`` words,
by 64-bit hash, in two generations: when the younger is full it becomes the older, whose words come
back when they are met again, and what was not met is forgotten with it. Marks behind a letter, which such tokenizers split off, are encoded by themselves,
and new words ``JOINED`` at a time as one text whose ids are told apart by the bytes they stand for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np

from signalloom.llm.kept import kept
from signalloom.llm.words import Words

LONG, JOINED = 64, 400
SPACED, WORD = "spaced", "word"
#: Words a worker remembers, some 40 bytes each, and new words encoded in one call.
REMEMBERED, AT_ONCE = 3_000_000, 20_000

_COMBINING = re.compile("[̀-\U0010ffff]")
_MARKS = b".,;:!?"
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def _find(hashes: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each key, -1 where it is not among the sorted ``hashes``."""
    if not len(hashes):
        return np.full(len(keys), -1, dtype=np.int64)
    i = np.minimum(np.searchsorted(hashes, keys), len(hashes) - 1)
    return np.where(hashes[i] == keys, places[i], -1)


def _within(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, as many as its size."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - sizes), sizes)


def _gathered(flat: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries ``flat[at[p] : at[p + 1]]`` of all places, one after another, and how many each has."""
    sizes = at[places + 1] - at[places]
    return flat[_within(at[places], sizes)], sizes


class Encoder:
    """Ids of texts. ``long_piece`` may be replaced by another way to encode a long unsplit text."""

    def __init__(self, path: str, kind: str, long_piece=None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.kind, self.space = kind, " " if kind == SPACED else ""
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        #: Bytes that each token stands for: a byte-level token has a character for each.
        self.width = np.zeros(max(vocabulary.values()) + 1, dtype=np.int64)
        for token, i in vocabulary.items():
            self.width[i] = len(token.removesuffix("</w>"))
        self.long_piece = long_piece or (lambda text: self.each([text])[0])
        self.marks: dict[bytes, np.ndarray] = {}
        self._begin()
        self._age()

    def _begin(self) -> None:
        """No words: ``hashes`` are sorted, and word ``places[k]`` has the ids ``flat[at[place] : at[place + 1]]``."""
        self.count, self.hashes, self.places = 0, np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
        self.at, self.flat = np.zeros(1 << 16, dtype=np.int64), np.empty(1 << 18, dtype=np.uint32)

    def _age(self) -> None:
        """Let go of the older generation, and begin a new one."""
        self.older = (self.hashes, self.places, self.at, self.flat)
        self._begin()

    def _recall(self, hashes: np.ndarray) -> None:
        """Take words of the older generation over that are not known to the younger. ``hashes`` are distinct."""
        known, places, at, flat = self.older
        missing = hashes[_find(self.hashes, self.places, hashes) < 0]
        place = _find(known, places, missing)
        there = place >= 0
        ids, sizes = _gathered(flat, at, place[there])
        self._add(missing[there], ids, sizes)

    def each(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are encoded one by one."""
        return [np.array(e.ids, dtype=np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
        """Numbers of words, the ids of all of them with what stands before them (a space, or nothing), and how many each has."""
        plain, alone = [], []
        for i, w in enumerate(words):
            if len(w) <= LONG and b"<|" not in w and (self.kind == SPACED or w.isascii()):
                plain.append(i)
            else:
                alone.append(i)
        extra = len(self.space)
        for first in range(0, len(plain), AT_ONCE):
            own = plain[first : first + AT_ONCE]
            groups = [own[i : i + JOINED] for i in range(0, len(own), JOINED)]
            texts = [self.space + b" ".join([words[i] for i in g]).decode() for g in groups]
            for g, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, dtype=np.uint32)
                at = np.zeros(len(ids) + 1, dtype=np.int64)
                np.cumsum(self.width[ids], out=at[1:])
                ends = np.cumsum([len(words[i]) + extra for i in g])
                cuts = np.searchsorted(at, ends)
                if at[-1] != ends[-1] or (at[np.minimum(cuts, len(at) - 1)] != ends).any():
                    alone += g  # a character that the tokenizer drops or rewrites
                else:
                    yield g, ids[: cuts[-1]], np.diff(cuts, prepend=0)
        short = [i for i in alone if len(words[i]) <= LONG]
        for first in range(0, len(short), AT_ONCE):
            own = short[first : first + AT_ONCE]
            ids = self.each([self.space + words[i].decode() for i in own])
            yield own, np.concatenate(ids), np.array([len(x) for x in ids])
        for i in alone:
            if len(words[i]) > LONG:
                ids = self.long_piece(self.space + words[i].decode())
                yield [i], ids, np.array([len(ids)])

    def _add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Remember words that are not known yet."""
        n, more = self.count, len(hashes)
        if not more:
            return
        if n + more + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros(max(len(self.at) // 2, more) + 1, dtype=np.int64)])
        self.at[n + 1 : n + 1 + more] = self.at[n] + np.cumsum(sizes)
        low, high = int(self.at[n]), int(self.at[n + more])
        if high > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty(max(len(self.flat) // 2, high - low), dtype=np.uint32)])
        self.flat[low:high] = ids
        order = np.argsort(hashes)
        where = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, where, hashes[order])
        self.places = np.insert(self.places, where, n + order)
        self.count = n + more

    def _learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Encode words, whose hashes are distinct and not known. Marks behind a letter are told apart first."""
        bare, ends, split, whole = [], [], [], []
        for i, w in enumerate(words):
            word = w.rstrip(_MARKS)
            last = word[-1:]
            if len(word) < len(w) and (last.isalpha() or last >= b"\x80" and word.decode()[-1].isalpha() and word.decode()[-1] < "\u0100"):
                bare.append(word)
                ends.append(w[len(word) :])
                split.append(i)
            else:
                whole.append(i)
        buffer = np.frombuffer(b" ".join(bare), dtype=np.uint8)
        of_bare = Words(buffer, np.array([0, len(buffer)])).hashes()
        distinct, first = np.unique(of_bare, return_index=True)
        self._recall(distinct)
        new, at = np.unique(np.concatenate([distinct, hashes[whole]]), return_index=True)
        unknown = _find(self.hashes, self.places, new) < 0
        new, at = new[unknown], at[unknown].tolist()
        first = first.tolist()
        texts = [bare[first[i]] if i < len(first) else words[whole[i - len(first)]] for i in at]
        parts = list(self._words(texts))
        if parts:
            self._add(new[np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]))
        if not split:
            return
        for end in dict.fromkeys(ends):
            if end not in self.marks:
                if len(self.marks) > 10_000:
                    self.marks.clear()
                self.marks[end] = self.each([end.decode()])[0]
        marks = {end: i for i, end in enumerate(dict.fromkeys(ends))}
        behind = [self.marks[end] if end in self.marks else self.each([end.decode()])[0] for end in marks]
        mark = np.fromiter((marks[end] for end in ends), np.int64, len(ends))
        mark_at = np.concatenate([[0], np.cumsum([len(x) for x in behind])])
        ids, sizes = _gathered(self.flat, self.at, _find(self.hashes, self.places, of_bare))
        tail, tails = _gathered(np.concatenate(behind), mark_at, mark)
        both = sizes + tails
        begin = np.cumsum(both) - both
        out = np.empty(int(both.sum()), dtype=np.uint32)
        out[_within(begin, sizes)] = ids
        out[_within(begin + sizes, tails)] = tail
        own = hashes[split]
        fresh = np.flatnonzero(_find(self.hashes, self.places, own) < 0)
        if len(fresh) < len(own):
            out, both = _gathered(out, np.append(begin, len(out)), fresh)
        self._add(own[fresh], out, both)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts ``offsets[i]:offsets[i + 1]`` of ``data``, one after another, and their offsets."""
        if self.kind == WORD:
            # Lower-casing A to Z early makes no difference where nothing is composed afterwards.
            text = data.tobytes()
            if b"<|" not in text and (text.isascii() or not _COMBINING.search(text.decode())):
                data = _LOWER[data]
        w = Words(data, offsets)
        n = len(w.starts)
        if self.kind == WORD:
            of, simple, start = np.arange(n), np.ones(n, dtype=bool), np.arange(n)
            text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(w.first))
            low, high = w.starts, w.ends
        else:
            # A piece begins at each single space between words, and at the start of each text.
            filled = np.flatnonzero(np.diff(offsets))
            single = np.zeros(n, dtype=bool)
            single[1:] = (w.starts[1:] - w.ends[:-1] == 1) & (data[w.ends[:-1]] == 32) if n else False
            heads = w.first[:-1][np.diff(w.first) > 0]
            single[heads] = False
            begin = np.concatenate([w.starts[single] - 1, offsets[filled]])
            word = np.concatenate([np.flatnonzero(single), np.full(len(filled), -1)])
            order = np.argsort(begin, kind="stable")
            low, start = begin[order], word[order]
            high = np.append(low[1:], len(data))
            text_of = np.searchsorted(offsets, low, "right") - 1
            simple = start >= 0
            simple &= w.ends[np.maximum(start, 0)] == high if n else False
        h = w.hashes() if n else np.empty(0, dtype=np.uint64)
        piece = np.empty(len(low), dtype=np.int64)
        own = h[start[simple]]
        uniq, first, back = np.unique(own, return_index=True, return_inverse=True)
        raw = data.tobytes()
        at = start[simple][first]
        if self.count + len(uniq) > REMEMBERED // 2:
            self._age()
        self._recall(uniq)
        unknown = np.flatnonzero(_find(self.hashes, self.places, uniq) < 0)
        if len(unknown):
            a, b = w.starts[at[unknown]].tolist(), w.ends[at[unknown]].tolist()
            self._learn([raw[i:j] for i, j in zip(a, b, strict=True)], uniq[unknown])
        piece[simple] = _find(self.hashes, self.places, uniq)[back]
        # Others hold unusual white space or begin a text: each distinct one is encoded here.
        odd = np.flatnonzero(~simple)
        texts = [raw[i:j] for i, j in zip(low[odd].tolist(), high[odd].tolist(), strict=True)]
        extra = {t: i for i, t in enumerate(dict.fromkeys(texts))}
        ids = self._odd(list(extra))
        flat, ends = self.flat, self.at
        if extra:
            known = self.count
            piece[odd] = np.fromiter((extra[t] for t in texts), np.int64, len(texts)) + known
            sizes = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))
            flat = np.concatenate([flat[: ends[known]], *ids])
            ends = np.concatenate([ends[: known + 1], ends[known] + sizes])
        size = ends[piece + 1] - ends[piece]
        out = np.zeros(len(piece) + 1, dtype=np.int64)
        np.cumsum(size, out=out[1:])
        got = flat[np.arange(out[-1]) + np.repeat(ends[piece] - out[:-1], size)]
        return got, out[np.searchsorted(text_of, np.arange(len(offsets)))]

    def _odd(self, texts: list[bytes]) -> list[np.ndarray]:
        short = [t for t in texts if len(t) <= 8 * LONG]
        ids = dict(zip(short, self.each([t.decode() for t in short]), strict=True))
        return [ids[t] if t in ids else self.long_piece(t.decode()) for t in texts]


def encoder(path: str, kind: str, long_piece=None) -> Encoder:
    """The encoder of this Python worker for a tokenizer file."""
    return kept((path, kind, long_piece), lambda: Encoder(path, kind, long_piece))
