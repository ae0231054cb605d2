"""Byte-pair encoding and decoding of whole texts in numpy merge rounds.

All symbols of many words lie in one flat array. In each round every pair of neighbours looks its
rank up by binary search over the sorted pair keys, every word takes its lowest rank, and all
places with that rank merge at once. Words that have no pair left leave the array.

Before that a batch is one array of code points, cut into pieces by the classes of neighbouring
code points. Pieces of up to 32 bytes are compared as whole numbers, so that each distinct one is
encoded once for a batch, and looked up by its hash (verified) among those met before; the cache
consists of a few arrays and starts anew when full. Longer pieces are told apart one by one.
Special tokens standing in a text get their own ids, as the file says. Decoding joins the tokens'
strings by blanks, because the file names no decoder.

Edge cases: null and empty texts have no ids and decode to an empty text; a text of white space
only as well. Lone surrogates are encoded as the replacement byte sequence of their code point.
Repeated rows are encoded alike. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from tillspark.llm.common import annotate, code_points, mix64, table, texts_of, utf8

CACHED_PIECES = 200_000
GROUP_BYTES = 2_000_000
KEY_WORDS = 4  # of 8 bytes
_NONE = np.iinfo(np.int64).max
# The classes and endings of the split pattern of the tokenizer file.
_LETTER, _NUMBER, _BLANK, _SIGN = range(4)
_CLASSES = {_LETTER: r"\p{L}+", _NUMBER: r"\p{N}+", _BLANK: r"\p{White_Space}+"}
_ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")  # after an apostrophe that begins a piece
END_OF_WORD = "</w>"


def default_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def byte_signs() -> list[str]:
    """The sign that stands for each byte: itself if it prints in Latin-1, else 256 and on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def _folded(text: str) -> str:
    """Composed and in lower case, sign by sign (a final sigma is no case of its own)."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
    return text.lower()


@functools.cache
def _class_of() -> np.ndarray:
    """The class of every code point."""
    every = "".join(map(chr, range(0x110000)))
    out = np.full(len(every), _SIGN, np.uint8)
    for kind, pattern in _CLASSES.items():
        for m in regex.finditer(pattern, every):
            out[m.start():m.end()] = kind
    return out


def cut(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, first byte and size of each piece, pieces of each text).

    A piece is a run of letters, one number, or a run of signs; an apostrophe that begins a run
    of signs takes one of the endings with it.
    """
    points = code_points("\n".join([*texts, ""]))  # the break is a blank, so no piece crosses it
    kind = _class_of()[points]
    before = np.r_[np.uint8(_BLANK), kind[:-1]]
    begins = (kind != _BLANK) & ((kind != before) | (kind == _NUMBER))
    quote = np.flatnonzero((points == ord("'")) & (before != _SIGN))
    if len(quote):
        after = np.r_[points, [10, 10]]
        one, two = after[quote + 1], after[quote + 2]
        for ending in _ENDINGS:
            hit = one == ord(ending[0])
            if len(ending) == 2:
                hit &= two == ord(ending[1])
            at = quote[hit]
            begins[at + 1] = False
            at = at + 1 + len(ending)
            begins[at[kind[at] == _LETTER]] = True
    first = np.flatnonzero(begins)
    stop = np.r_[begins[1:], True] | np.r_[kind[1:] == _BLANK, True]
    last = np.flatnonzero(stop & (kind != _BLANK)) + 1
    ends = np.cumsum([len(t) + 1 for t in texts])
    of_text = np.diff(np.searchsorted(first, ends), prepend=0)
    flat = np.frombuffer(utf8("\n".join([*texts, ""])), np.uint8)
    if len(flat) > len(points):
        at = np.r_[0, np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))]
        first, last = at[first], at[last]
    return flat, first, last - first, of_text


def keys(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(KEY_WORDS, pieces): the bytes of pieces of up to 8 * KEY_WORDS bytes as whole numbers."""
    room = np.r_[flat, np.zeros(8 * KEY_WORDS, np.uint8)]
    window = np.ndarray((len(room) - 7,), "<u8", room, strides=(1,))
    mask = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
    out = np.zeros((KEY_WORDS, len(first)), np.uint64)
    out[0] = window[first] & mask[np.minimum(size, 8)]
    for j in range(1, KEY_WORDS):
        more = np.flatnonzero(size > 8 * j)
        out[j, more] = window[first[more] + 8 * j] & mask[np.minimum(size[more] - 8 * j, 8)]
    return out


def hashes(key: np.ndarray, size: np.ndarray) -> np.ndarray:
    out = mix64(key[0] + (size.astype(np.uint64) << np.uint64(56)))
    for j in range(1, KEY_WORDS):
        more = np.flatnonzero(size > 8 * j)
        out[more] = mix64(out[more] ^ key[j, more])
    return out


def distinct(key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place of the first, number of the distinct piece of each piece)."""
    found = hashes(key, size)
    value, first, number = np.unique(found, return_index=True, return_inverse=True)
    same = first[number]
    if (key[:, same] == key).all() and (size[same] == size).all():
        return value, first, number
    order = np.lexsort((size, *key))  # two pieces of one hash: compare the pieces themselves
    new = np.r_[True, (key[:, order[1:]] != key[:, order[:-1]]).any(axis=0)
                | (size[order[1:]] != size[order[:-1]])]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return found[order[new]], order[new], number


class Encoder:
    """Encodes and decodes batches of texts by one tokenizer file (word-end byte-level BPE)."""

    def __init__(self, path: str | None = None, cached_pieces: int = CACHED_PIECES):
        with open(path or default_path(), encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        signs = byte_signs()
        self.inner = np.array([vocab[c] for c in signs], np.int64)
        self.last = np.array([vocab[c + END_OF_WORD] for c in signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.merged = keys[order], order.astype(np.int64), merged[order]
        self.split = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") \
            if self.special else None
        self.cached_pieces = cached_pieces
        self._forget()
        names = [b""] * self.size
        for text, i in [*vocab.items(), *self.special.items()]:
            names[i] = utf8(text) + b" "
        self.name_size = np.array([len(n) for n in names], np.int64)
        self.name_start = np.cumsum(self.name_size) - self.name_size
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def _forget(self) -> None:
        """An empty cache: hash, key and size of each piece, place and number of its ids."""
        self.hash = np.zeros(0, np.uint64)
        self.key = np.zeros((KEY_WORDS, 0), np.uint64)
        self.size_of = self.start = self.count = np.zeros(0, np.int64)
        self.pool = np.zeros(0, "<u4")

    def _ranked(self, symbol: np.ndarray, word: np.ndarray, some: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of the pairs that begin at the places ``some``."""
        partner = np.minimum(some + 1, len(symbol) - 1)
        key = np.where((word[partner] == word[some]) & (partner > some),
                       symbol[some] * self.size + symbol[partner], -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.rank[at], _NONE), self.merged[at]

    def merge(self, flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, ids of each), given the bytes of all pieces and their sizes."""
        symbol, ends = self.inner[flat], np.cumsum(sizes) - 1
        symbol[ends] = self.last[flat[ends]]
        word = np.repeat(np.arange(len(sizes)), sizes)
        rank, merged = self._ranked(symbol, word, np.arange(len(symbol)))
        done_words, done_ids = [], []
        while len(symbol):
            first = np.r_[True, word[1:] != word[:-1]]
            starts = np.flatnonzero(first)
            lowest = np.minimum.reduceat(rank, starts)
            lengths = np.diff(np.r_[starts, len(symbol)])
            goes_on = np.repeat(lowest != _NONE, lengths)
            done_words.append(word[~goes_on])
            done_ids.append(symbol[~goes_on].astype("<u4"))
            chosen = np.flatnonzero(goes_on & (rank == np.repeat(lowest, lengths)))
            if len(chosen):
                # In a run such as "aaa" every second place merges, from the left.
                new_run = np.r_[True, chosen[1:] != chosen[:-1] + 1]
                offset = np.arange(len(chosen)) - np.flatnonzero(new_run)[np.cumsum(new_run) - 1]
                chosen = chosen[offset % 2 == 0]
                symbol[chosen] = merged[chosen]
                goes_on[chosen + 1] = False
            place = np.cumsum(goes_on) - 1
            symbol, word, rank, merged = (x[goes_on] for x in (symbol, word, rank, merged))
            if len(chosen):  # only pairs beside a merged one have changed
                own = place[chosen]
                changed = np.zeros(len(symbol), bool)
                changed[own] = changed[np.maximum(own - 1, 0)] = True
                touched = np.flatnonzero(changed)
                rank[touched], merged[touched] = self._ranked(symbol, word, touched)
        word = np.concatenate([np.zeros(0, np.int64), *done_words])
        ids = np.concatenate([np.zeros(0, "<u4"), *done_ids])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(sizes))

    def _looked_up(self, flat: np.ndarray, first: np.ndarray, size: np.ndarray
                   ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pool of ids, place of each piece's ids there, their number); fresh ones are merged."""
        key = keys(flat, first, size)
        value, shown, number = distinct(key, size)
        key, of = key[:, shown], size[shown]
        at = np.minimum(np.searchsorted(self.hash, value), max(len(self.hash) - 1, 0))
        known = np.zeros(len(value), bool)
        if len(self.hash):
            known = (self.hash[at] == value) & (self.key[:, at] == key).all(axis=0) & (
                self.size_of[at] == of)
        fresh = np.flatnonzero(~known)
        ids, counts = self._merged_at(flat, first[shown[fresh]], of[fresh])
        pool = np.concatenate([self.pool, ids])
        start, count = np.zeros(len(value), np.int64), np.zeros(len(value), np.int64)
        if known.any():
            start[known], count[known] = self.start[at[known]], self.count[at[known]]
        start[fresh] = len(self.pool) + np.cumsum(counts) - counts
        count[fresh] = counts
        self._keep(value, key, of, start, count, fresh, pool, ids)
        return pool, start[number], count[number]

    def _merged_at(self, flat, first, size):
        place = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        return self.merge(flat[place], size)

    def _keep(self, value, key, size, start, count, fresh, pool, ids) -> None:
        """Adds the fresh pieces to the cache; one of a hash is enough. It starts anew when full."""
        if len(self.hash) + len(fresh) > self.cached_pieces:
            self._forget()
            start = start.copy()
            start[fresh] -= len(pool) - len(ids)
            pool = ids
            if len(fresh) > self.cached_pieces:
                return
        hashed = np.r_[self.hash, value[fresh]]
        _, one = np.unique(hashed, return_index=True)
        self.hash = hashed[one]
        self.key = np.concatenate([self.key, key[:, fresh]], axis=1)[:, one]
        self.size_of = np.r_[self.size_of, size[fresh]][one]
        self.start = np.r_[self.start, start[fresh]][one]
        self.count = np.r_[self.count, count[fresh]][one]
        self.pool = pool

    def _plain(self, texts: list[str]) -> list[bytes]:
        flat, first, size, of_text = cut([_folded(t) for t in texts])
        short = size <= 8 * KEY_WORDS
        start, count = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        pool, start[short], count[short] = self._looked_up(flat, first[short], size[short])
        if not short.all():
            whole = flat.tobytes()
            seen: dict[bytes, int] = {}
            number = [seen.setdefault(whole[a:a + n], len(seen)) for a, n in zip(
                first[~short].tolist(), size[~short].tolist())]
            ids, counts = self.merge(np.frombuffer(b"".join(seen), np.uint8),
                                     np.fromiter(map(len, seen), np.int64, len(seen)))
            start[~short] = (len(pool) + np.cumsum(counts) - counts)[number]
            count[~short] = counts[number]
            pool = np.concatenate([pool, ids])
        before = np.cumsum(count) - count
        ids = pool[np.arange(int(count.sum())) + np.repeat(start - before, count)].tobytes()
        ends = np.r_[0, np.cumsum(count)][np.cumsum(of_text)] * 4
        return [ids[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_bytes(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        if self.split is None or not any("<|" in t and self.split.search(t) for t in texts):
            return self._plain(texts)
        parts = [self.split.split(t) for t in texts]
        plain = iter(self._plain([p for row in parts for p in row[::2]]))
        out = []
        for row in parts:
            pieces = [next(plain)]
            for token in row[1::2]:
                pieces += [np.array([self.special[token]], "<u4").tobytes(), next(plain)]
            out.append(b"".join(pieces))
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.frombuffer(b, "<u4") for b in self.encode_bytes(texts)]

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The tokens' strings joined by blanks, in UTF-8."""
        parts = []
        for i in range(0, len(ids), 1 << 18):
            part = ids[i:i + (1 << 18)].astype(np.int64)
            sizes = self.name_size[part]
            shift = self.name_start[part] - (np.cumsum(sizes) - sizes)
            place = np.arange(int(sizes.sum())) + np.repeat(shift, sizes)
            parts.append(self.names[place].tobytes())
        return b"".join(parts)[:-1]

    def decode(self, rows: list[np.ndarray]) -> list[str]:
        return [self.decode_bytes(ids).decode("utf-8", "surrogatepass") for ids in rows]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(row, ids): every document and its token ids."""
    def begin():
        encoder = Encoder(path)
        return lambda batch: (encoder.encode(texts_of(batch, "text")),)

    return annotate(docs, "text", begin, "ids array<int>", GROUP_BYTES)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(row, decoded) of rows with a column ``ids``; null ids are an empty text."""
    def begin():
        encoder = Encoder(path)

        def work(batch):
            ids = [np.array(x or [], np.int64) for x in batch.column("ids").to_pylist()]
            return (encoder.decode(ids),)
        return work

    return annotate(rows, "ids", begin, "decoded string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256): both directions of every text, as digests."""
    def begin():
        encoder = Encoder(path)

        def work(batch):
            ids = encoder.encode_bytes(texts_of(batch, "text"))
            back = [encoder.decode_bytes(np.frombuffer(b, "<u4")) for b in ids]
            return ([len(b) // 4 for b in ids], [hashlib.sha256(b).hexdigest() for b in ids],
                    [hashlib.sha256(b).hexdigest() for b in back])
        return work

    return annotate(docs, "text", begin,
                    "n_tokens long, ids_sha256 string, decoded_sha256 string", GROUP_BYTES)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digests(docs).select("row.doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
