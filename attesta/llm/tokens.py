"""Token ids of many texts: texts are cut where a tokenizer cuts anyway, and each distinct piece is encoded once.

Cuts are made between ASCII characters and the letters U+00C0 to U+00FF only, at places that no pre-token of the two
tokenizers can span; the rest stays in one piece, so the ids are those of the whole text. New words are encoded many at a
time, as a text of words; the bytes that each id stands for say where a word ends. Literals that the tokenizer file adds (as the end of text)
part a text first and become their own ids, as in the library. A worker keeps the ids of the pieces it has met, up to
``MAX_PIECES`` and ``MAX_POOL``; what it forgets is encoded again. Pieces are found by hash and held byte for byte
against the one whose ids they take.
"""

from __future__ import annotations

import os
import re
from itertools import chain

import numpy as np

from attesta.llm.common import KEPT, padded, ragged, same_spans, span_hash

MAX_PIECES = 300_000
#: Bytes of pieces kept, and ids.
MAX_POOL = 4 << 20
#: Text that is held as arrays at once; these take about 40 bytes for each of text.
CHUNK_BYTES = 1 << 20
#: New words that are encoded as one text.
WORDS = 4096

LETTER, DIGIT, MARK, SPACE, BLANK, OTHER = range(6)
_CLASS = np.full(256, OTHER, np.uint8)
_CLASS[0x21:0x7F] = MARK
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = LETTER
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x20] = SPACE
_CLASS[0x09:0x0E] = BLANK
_CLASS[0x27] = OTHER  # an apostrophe may begin a contraction
#: A piece that is one pre-token of letters, and maybe the space before it.
_WORD = re.compile(r" ?[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


class Encoder:
    """Ids by one of the public tokenizers. ``drops_space``: white space separates and lower case is made first;
    else a space before a word belongs to it and every byte is kept."""

    def __init__(self, path: str, drops_space: bool):
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.drops_space = drops_space
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None) or ""
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        #: Bytes of each id: a character of a token stands for one.
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(suffix))
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        if odd := [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.normalized or t.lstrip or t.rstrip or t.single_word]:
            raise ValueError(f"added tokens that aren't plain literals: {', '.join(odd)}")
        self.added = added
        self.literal = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")") if added else None
        self._forget()

    def _forget(self):
        self.hash = np.zeros(0, np.uint64)  # ascending, with the number of the piece of each
        self.number = np.zeros(0, np.int64)
        self.offset = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin = np.zeros(0, np.int64)  # the bytes of each piece
        self.octets, self.filled = np.zeros(1 << 16, np.uint8), 0

    def cuts(self, units: np.ndarray, size: int, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces; ``first``: where texts begin, each ending one before the next."""
        kind = _CLASS[units[:size]]
        lead = np.flatnonzero(units[:size] == 0xC3)  # U+00C0 to U+00FF are letters but for the signs of multiplication and division
        lead = lead[(units[lead + 1] != 0x97) & (units[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = LETTER
        word = kind <= MARK
        white = (kind == SPACE) | (kind == BLANK)
        begin = np.zeros(size + 1, bool)
        begin[1:size] = word[1:] & word[:-1] & (kind[1:] != kind[:-1])
        if self.drops_space:
            begin[1:size] |= white[1:] != white[:-1]
        else:
            begin[1:size] |= word[:-1] & white[1:]
            last = (kind[:-1] == SPACE) & word[1:]  # the last space of a run
            begin[1 : size - 1] |= white[:-2] & last[1:]
            begin[2:size] |= word[:-2] & (kind[1:-1] == BLANK) & word[2:]
        begin[first[:-1]] = True
        starts = np.flatnonzero(begin[:size])
        ends = np.append(starts[1:], size)
        text_end = first[1:][np.searchsorted(first, starts, "right") - 1] - 1
        ends = np.minimum(ends, text_end)
        keep = ends > starts
        if self.drops_space:
            keep &= ~white[np.minimum(starts, size - 1)]
        return starts[keep], ends[keep]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        if not any(x in t for x in self.added for t in texts):
            return self._plain(texts)
        parts, owner, after = [], [], []
        for k, t in enumerate(texts):
            cut = self.literal.split(t)  # text, literal, text, ..., text
            parts += cut[0::2]
            after += [*(self.added[x] for x in cut[1::2]), -1]
            owner += [k] * len(cut[0::2])
        ids, n = self._plain(parts)
        after = np.array(after, np.int64)
        ids = np.insert(ids, np.cumsum(n)[after >= 0], after[after >= 0])
        return ids, np.bincount(owner, n + (after >= 0), len(texts)).astype(np.int64)

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`encode`, of texts without added literals."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join(raw) + b"\n"
        units = padded(data)
        if self.drops_space:
            units = _LOWER[units]
        first = np.cumsum([0, *(len(r) + 1 for r in raw)])
        starts, ends = self.cuts(units, len(data), first)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        keys, example, inverse = np.unique(span_hash(units, starts, ends), return_index=True, return_inverse=True)
        piece = self._ids(keys, units, starts[example], ends[example])[inverse]
        offset, count = self.offset[piece], self.length[piece]
        # a piece that only shares its hash with the one found is encoded by itself
        size = ends - starts
        alike = size == np.append(self.begin, self.filled)[piece + 1] - self.begin[piece]
        alike[alike] = same_spans(units, starts[alike], self.octets, self.begin[piece[alike]], size[alike])
        ids = self.pool
        if not alike.all():
            own = [np.array(x, np.uint32) for x in self._encode(_texts(units, starts[~alike], ends[~alike]))]
            count[~alike] = [len(x) for x in own]
            offset[~alike] = len(ids) + np.cumsum(count[~alike]) - count[~alike]
            ids = np.concatenate([ids, *own])
        total = np.concatenate(([0], np.cumsum(count)))
        at = np.searchsorted(starts, first)
        return ids[ragged(offset, count)], np.diff(total[at])

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.hash, keys)
        inside = np.minimum(place, max(len(self.hash) - 1, 0))
        return place, (self.hash[inside] == keys) if len(self.hash) else np.zeros(len(keys), bool)

    def _ids(self, keys, units, starts, ends) -> np.ndarray:
        """The number of the kept piece for each of the ascending ``keys``."""
        place, found = self._find(keys)
        new = np.flatnonzero(~found)
        if len(new):
            if len(self.hash) and (len(self.hash) + len(new) > MAX_PIECES or self.filled > MAX_POOL or self.used * 4 > MAX_POOL):
                self._forget()
                place, found = self._find(keys)
                new = np.arange(len(keys))
            ids = self._encode(_texts(units, starts[new], ends[new]))
            length = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
            size = ends[new] - starts[new]
            self.pool, offset, self.used = _kept(self.pool, self.used, flat, length)
            self.octets, begin, self.filled = _kept(self.octets, self.filled, units[ragged(starts[new], size)], size)
            self.number = np.insert(self.number, place[new], len(self.offset) + np.arange(len(new)))
            self.hash = np.insert(self.hash, place[new], keys[new])
            self.offset, self.length, self.begin = (np.concatenate(x) for x in ((self.offset, offset), (self.length, length), (self.begin, begin)))
            place = np.searchsorted(self.hash, keys)
        return self.number[place]

    def _encode(self, pieces: list[str]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        words, rest = [], []
        for i, piece in enumerate(pieces):
            (words if _WORD.fullmatch(piece) and (self.drops_space or piece[0] == " ") else rest).append(i)
        for k in range(0, len(words), WORDS):
            some = words[k : k + WORDS]
            found = self._words([pieces[i] for i in some])
            if found is None:
                rest += some
                continue
            for i, ids in zip(some, found, strict=True):
                out[i] = ids
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _words(self, words: list[str]) -> list[list[int]] | None:
        """Ids of each of several words, encoded as one text; None if the bytes of the ids don't end where the words do."""
        ids = self.tokenizer.encode_batch_fast([(" " if self.drops_space else "").join(words)], add_special_tokens=False)[0].ids
        size = np.cumsum(self.width[ids])
        ends = np.cumsum([len(w.encode()) for w in words])
        last = np.searchsorted(size, ends)
        if not len(size) or size[-1] != ends[-1] or (size[last] != ends).any():
            return None
        last = (last + 1).tolist()
        return [ids[a:b] for a, b in zip([0, *last[:-1]], last, strict=True)]


def _texts(units: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    raw = units.tobytes()
    return [raw[s:e].decode("utf-8", "surrogatepass") for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


def _kept(pool: np.ndarray, used: int, flat: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """``pool`` with ``flat`` after its first ``used`` items (zeros follow), where each part begins, and the new end."""
    end = used + len(flat)
    while end + 8 > len(pool):
        pool = np.concatenate((pool, np.zeros_like(pool)))
    pool[used:end] = flat
    return pool, used + np.cumsum(length) - length, end


_ENCODERS: dict[tuple[str, bool], Encoder] = {}
KEPT["tokens"] = _ENCODERS


def encoder(path: str, drops_space: bool) -> Encoder:
    """The worker's own encoder, kept from task to task."""
    if (path, drops_space) not in _ENCODERS:
        _ENCODERS[path, drops_space] = Encoder(path, drops_space)
    return _ENCODERS[path, drops_space]
