"""BPE encoding and decoding with forced boundaries.

A pair of neighbouring bytes that occurs inside no vocabulary token can never be
merged across, so a word is cut there. The fragments of all new words of some texts lie in one
array, where each has its own next merge in every round; their ids are put together again by words.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back

#: Entries of either generation of a worker's memory of encoded words; longer words are not remembered.
REMEMBERED, LONGEST = 60_000, 64
#: Characters of texts that are encoded at once, and bytes from which on a fragment is merged by itself.
AT_ONCE, LONG = 2_000_000, 48
_NEVER = np.int64(1) << 31

#: Texts of these characters only are split by one expression here; others by the tokenizer's own normalizer and splitter.
_OTHER = re.compile("[^\t\n\r -~À-įı-ſ]")
_SPLIT = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[^ \t\n\ra-zß-öø-ſ0-9]+")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(spare)) for b in range(256)]


class _Memory:
    """Words with their ids and decoded bytes, in two generations: when the younger is full it becomes the elder, and what is used again moves on."""

    def __init__(self):
        self.young, self.old = ({}, {}), ({}, {})

    def hold(self, words: set, make) -> tuple[dict, dict]:
        """Dicts (ids, decoded) that hold all of ``words``; ``make`` encodes those not yet known."""
        ids, decoded = self.young
        new = []
        for w in words - ids.keys():
            known = self.old[0].get(w)
            if known is None:
                new.append(w)
            else:
                ids[w], decoded[w] = known, self.old[1][w]
        for w, i, d in zip(new, *make(new), strict=True) if new else ():
            ids[w], decoded[w] = i, d
        return ids, decoded

    def settle(self, words: set) -> None:
        for w in words:
            if len(w) > LONGEST:
                del self.young[0][w], self.young[1][w]
        if len(self.young[0]) > REMEMBERED:
            self.young, self.old = ({}, {}), self.young


class Codec:
    """Encodes and decodes as the tokenizers library does with the same file and no added special tokens."""

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        model = json.loads(spec)
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        vocab, end = model["model"]["vocab"], model["model"]["end_of_word_suffix"]
        letters = byte_letters()
        byte = {c: b for b, c in enumerate(letters)}
        self.byte = byte
        self.single = [vocab[c] for c in letters] + [vocab[c + end] for c in letters]  # the last 256 end a word
        self.merges, self.size = {}, 1 + max(vocab.values())
        for rank, pair in enumerate(model["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        pairs = np.array([a * self.size + b for a, b in self.merges] + [np.iinfo(np.int64).max], np.int64)
        order = np.argsort(pairs)
        self.pairs, self.ranks = pairs[order], np.array([*(r for r, _ in self.merges.values()), _NEVER], np.int64)[order]
        self.into = np.zeros(len(pairs), np.int64)  # by rank
        for rank, new in self.merges.values():
            self.into[rank] = new
        self.inside = bytearray(256 * 512)
        for token in vocab:
            if token in added:
                continue
            last = token.endswith(end)
            bs = [byte[c] for c in (token[: -len(end)] if last else token)]
            for i in range(len(bs) - 1):
                self.inside[bs[i] * 512 + bs[i + 1] + 256 * (last and i == len(bs) - 2)] = 1
        self.cuttable = ~np.frombuffer(self.inside, np.uint8).astype(bool)
        self.added, self.special = added, re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.bytes_of = {ord(c): chr(b) for c, b in byte.items()}
        self.memory, self.first = _Memory(), np.array(self.single, np.int64)
        self.token = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in [*vocab.items(), *added.items()]:
            self.token[i] = t.encode()
        self.width = np.array([len(t) + 1 for t in self.token], np.int64)

    def cuts(self, word: bytes) -> list[int]:
        """Forced boundaries of a word: a cut before each of these places."""
        n, inside = len(word), self.inside
        return [i for i in range(1, n) if not inside[word[i - 1] * 512 + word[i] + (256 if i == n - 1 else 0)]]

    def encode_words(self, words: list[str]) -> tuple[list[bytes], list[bytes]]:
        """Ids (little-endian unsigned 32-bit) and decoded bytes of each of ``words``, none of them empty."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(w) for w in raw], np.int64)
        flat, ends = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64), np.cumsum(sizes)
        last = np.zeros(len(flat), np.int64)
        last[ends - 1] = 256
        starts = np.zeros(len(flat), bool)
        starts[1:] = self.cuttable[flat[:-1] * 512 + flat[1:] + last[1:]]  # forced boundaries
        starts[ends - sizes] = True
        begin = np.flatnonzero(starts)
        ids, count = self.encode_fragments(self.first[flat + last], begin)
        total = np.concatenate([[0], np.cumsum(count)])
        at = total[np.concatenate([np.searchsorted(begin, ends - sizes), [len(begin)]])].tolist()
        packed = ids.astype("<u4").tobytes()
        text = b" ".join(map(self.token.__getitem__, ids.tolist()))
        place = np.concatenate([[0], np.cumsum(self.width[ids])])[at].tolist()
        return [packed[4 * a : 4 * b] for a, b in zip(at, at[1:], strict=False)], [text[a : b - 1] for a, b in zip(place, place[1:], strict=False)]

    def encode_fragments(self, symbols: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many each) of fragments that lie end to end in ``symbols``, each from its place in ``begin`` on.

        In a round every fragment makes its merge of least rank, the leftmost of equals; one without a merge is done.
        """
        sizes = np.diff(np.append(begin, len(symbols)))
        number, done = np.arange(len(begin)), []
        large = np.flatnonzero(sizes > LONG)
        if len(large):
            for k in large.tolist():
                got = np.array(self._long(symbols[begin[k] : begin[k] + sizes[k]].tolist()), np.int64)
                done.append((np.array([k]), np.array([len(got)]), got))
            small = np.repeat(sizes <= LONG, sizes)
            symbols, number, sizes = symbols[small], number[sizes <= LONG], sizes[sizes <= LONG]
        rank = self._ranks(symbols[:-1], symbols[1:])
        rank = np.append(rank, _NEVER)[: len(symbols)]
        rank[np.cumsum(sizes) - 1] = _NEVER
        while len(number):
            least = np.minimum.reduceat((rank << 31) | np.arange(len(rank)), np.cumsum(sizes) - sizes)
            at, best = least & (_NEVER - 1), least >> 31
            idle = best >= _NEVER
            stay = np.ones(len(symbols), bool)
            if idle.any():
                over = np.repeat(idle, sizes)
                done.append((number[idle], sizes[idle], symbols[over]))
                stay = ~over
                at, best, number, sizes = at[~idle], best[~idle], number[~idle], sizes[~idle]
            symbols[at] = self.into[best]
            stay[at + 1] = False
            place = (np.cumsum(stay) - 1)[at]
            symbols, rank, sizes = symbols[stay], rank[stay], sizes - 1
            ends = np.cumsum(sizes) - 1
            right, left = place[place < ends], place[place > ends - sizes + 1] - 1
            rank[right] = self._ranks(symbols[right], symbols[right + 1])
            rank[ends] = _NEVER
            rank[left] = self._ranks(symbols[left], symbols[left + 1])
        order = np.argsort(np.concatenate([d[0] for d in done])) if done else np.zeros(0, np.int64)
        count = np.concatenate([d[1] for d in done]) if done else np.zeros(0, np.int64)
        ids = np.concatenate([d[2] for d in done]) if done else np.zeros(0, np.int64)
        from_ = (np.cumsum(count) - count)[order]
        count = count[order]
        return ids[np.repeat(from_ - (np.cumsum(count) - count), count) + np.arange(len(ids))], count

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pair = a * self.size + b
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.ranks[at], _NEVER)

    def _long(self, ids: list[int]) -> list[int]:
        """The merges of one fragment, with a heap over a linked list."""
        n, get = len(ids), self.merges.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(n - 1) if (m := get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j], right[i] = new, -1, right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for x in (left[i], i):
                if x >= 0 and right[x] >= 0 and (m := get((ids[x], ids[right[x]]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[right[x]], m[1]))
        return [x for x in ids if x >= 0]

    def _plain(self, text: str) -> list[str]:
        if _OTHER.search(text) is None:
            return _SPLIT.findall(text.lower())
        pieces = self.whole.pre_tokenizer.pre_tokenize_str(self.whole.normalizer.normalize_str(text))
        return [p.translate(self.bytes_of).encode("latin-1").decode() for p, _ in pieces if p]

    def encode_texts(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """(ids as little-endian unsigned 32-bit integers, decoded text) of each text."""
        parts = []  # (number of the text, added token or None, words)
        for k, t in enumerate(texts):
            if t and self.special and "<|" in t and self.special.search(t):
                parts += [(k, p if p in self.added else None, [] if p in self.added else self._plain(p)) for p in self.special.split(t) if p]
            elif t:
                parts.append((k, None, self._plain(t)))
        need = set().union(*[w for _, _, w in parts])
        ids, decoded = self.memory.hold(need, self.encode_words)
        out: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        for k, added, words in parts:
            if added:
                out[k][0].append(self.added[added].to_bytes(4, "little"))
                out[k][1].append(added.encode())
            elif words:
                out[k][0].append(b"".join(map(ids.__getitem__, words)))
                out[k][1].append(b" ".join(map(decoded.__getitem__, words)))
        self.memory.settle(need)
        return [(b"".join(i), b" ".join(d).decode()) for i, d in out]

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return self.encode_texts([text])[0][0]

    def decode(self, ids: bytes) -> str:
        """The tokens' strings, one blank between: this tokenizer has no decoder of its own."""
        return b" ".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode()


def _some(texts: list, most: int):
    """(first, end) of runs of texts of about ``most`` characters."""
    lo = held = 0
    for k, t in enumerate(texts):
        held += len(t) if isinstance(t, str) else 0
        if held >= most:
            yield lo, k + 1
            lo, held = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_codecs: dict[int, Codec] = {}


def encode(docs: DataFrame, path: str, text: str = "text", decode: bool = True, into: tuple[str, str] = ("token_ids", "decoded")) -> DataFrame:
    """``docs`` with the ids of ``text`` (binary, little-endian unsigned 32-bit) and, with ``decode``, their decoded text.

    ``path``: a tokenizers file of a byte-level BPE with word ends, read by the driver; the vocabulary, of fixed size, is broadcast.
    Null and empty texts have no ids and decode to the empty string. Columns named as the new ones are replaced.
    Whole texts are encoded, one row in and one row out, without a shuffle.
    """
    with open(path) as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())
    rest = [c for c in docs.columns if c not in into]
    (own_text,) = fresh([*rest, *into], "text")

    def run(batches):
        key = hash(spec.value)
        codec = _codecs.get(key) or _codecs.setdefault(key, Codec(spec.value))
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf[own_text].tolist()]
            for lo, hi in _some(texts, AT_ONCE):
                got = codec.encode_texts(texts[lo:hi])
                new = {into[0]: [i for i, _ in got]} | ({into[1]: [d for _, d in got]} if decode else {})
                yield pd.concat([pdf.iloc[lo:hi].drop(columns=own_text).reset_index(drop=True), pd.DataFrame(new)], axis=1)
        give_back()

    from pyspark.sql import types as T

    own = docs.select(*rest, F.col(text).alias(own_text))
    fields = [*own.schema.fields[:-1], T.StructField(into[0], T.BinaryType())] + ([T.StructField(into[1], T.StringType())] if decode else [])
    return own.mapInPandas(run, T.StructType(fields))
