"""Token ids of whole texts by the tokenizers library, with a memo of space-led chunks.

A byte-level pre-tokenizer never joins characters across a single space, so the
ids of a text are the ids of its space-led chunks one after another, unless white
space, a space and white space (or the end) follow each other; such texts are
encoded whole. Chunks are told apart by a 64-bit hash and their length; those seen
before are looked up in a NumPy hash table, new ones are encoded by the library,
many in one call, and cut before each token that starts with a space. A full memo
keeps what was met again.
"""

from __future__ import annotations

import os
import re

import numpy as np

from .common import resident

SLOTS = 1 << 22  # places of the memo, 17 bytes each
GROUP_BYTES = 1 << 19
_UNSAFE = re.compile(r"\s (?:\s|$)")
_EDGE = re.compile(r"^\s|\s$|^$")
_ODD = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_HEAD = np.uint64(0x94D049BB133111EB)


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, GROUP_BYTES)
            steps = np.full(n, _ODD, np.uint64)
            back = np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
            steps[0] = back[0] = 1
            self.up, self.down = np.multiply.accumulate(steps), np.multiply.accumulate(back)


class Memo:
    """Open-addressing table from hashes to runs of ids in one pool."""

    def __init__(self, dtype: np.dtype, places: int):
        self.dtype, self.places = dtype, places
        self.clear()

    def clear(self) -> None:
        self.keys, self.starts, self.sizes = np.zeros(self.places, np.uint64), np.zeros(self.places, np.int32), np.zeros(self.places, np.int32)
        self.pool, self.used, self.n = np.zeros(1 << 20, self.dtype), 0, 0
        self.met = np.zeros(self.places, bool)  # looked up again since it was added or last kept

    def renew(self) -> None:
        """Makes room: what was met again stays, what was not goes (all goes if too much was)."""
        slot = np.flatnonzero(self.met)
        hashes, sizes, starts = self.keys[slot], self.sizes[slot].astype(np.int64), self.starts[slot]
        after = np.cumsum(sizes)
        ids = self.pool[np.repeat(starts - after + sizes, sizes) + np.arange(after[-1] if len(after) else 0)]
        self.clear()
        if len(hashes) <= self.places // 4:
            self.add(hashes, ids, sizes)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash, or of the free place it would take."""
        slot = (hashes & np.uint64(self.places - 1)).astype(np.int64)
        open_ = np.arange(len(hashes))
        while len(open_):
            held = self.keys[slot[open_]]
            open_ = open_[(held != 0) & (held != hashes[open_])]
            slot[open_] = (slot[open_] + 1) & (self.places - 1)
        return slot

    def add(self, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """New, distinct hashes with their ids one after another."""
        starts = self.used + np.cumsum(sizes) - sizes
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += len(hashes)
        left = np.arange(len(hashes))
        while len(left):
            slot = self.slots(hashes[left])
            self.keys[slot] = hashes[left]  # of two for one slot, the last stays
            won = self.keys[slot] == hashes[left]
            self.starts[slot[won]], self.sizes[slot[won]] = starts[left[won]], sizes[left[won]]
            left = left[~won]


class Encoder:
    def __init__(self, path: str, slots: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        top = max(vocabulary.values()) + 1
        self.dtype = np.dtype("<u2" if top <= 1 << 16 else "<u4")
        self.leads = np.zeros(top, bool)
        for token, i in vocabulary.items():
            self.leads[i] = token.startswith("Ġ")
        kind = str(self.tokenizer.pre_tokenizer)
        self.chunked = "ByteLevel" in kind and "add_prefix_space=False" in kind and self.tokenizer.normalizer is None
        self.memo, self.powers = Memo(self.dtype, slots or SLOTS), Powers()

    @classmethod
    def of(cls, path: str, slots: int | None = None) -> "Encoder":
        """One encoder per worker process. slots: places of its memo (a power of two);
        a smaller memo takes more time and gives the same ids."""
        return resident(("encoder", path, slots), lambda: cls(path, slots))

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str], hashes: np.ndarray, heads: np.ndarray) -> None:
        alone = np.array([bool(_EDGE.search(c)) for c in chunks]) | heads
        at = np.flatnonzero(~alone)
        for i in range(0, len(at), 2000):
            part = at[i : i + 2000]
            ids = self._plain([" " + " ".join([chunks[j] for j in part])])[0]
            cuts = np.flatnonzero(self.leads[ids])
            if len(cuts) == len(part) and cuts[0] == 0:
                self.memo.add(hashes[part], ids, np.diff(np.append(cuts, len(ids))))
            else:
                alone[part] = True
        at = np.flatnonzero(alone)
        if len(at):
            ids = self._plain([chunks[j] if heads[j] else " " + chunks[j] for j in at])
            self.memo.add(hashes[at], np.concatenate(ids), np.array([len(x) for x in ids]))

    def _parts(self, text: bytes) -> list[bytes]:
        """The text cut before single spaces into parts of about GROUP_BYTES."""
        parts, begin = [], 0
        while len(text) - begin > 2 * GROUP_BYTES:
            cut = text.find(b" ", begin + GROUP_BYTES)
            if cut < 0:
                break
            parts.append(text[begin:cut])
            begin = cut + 1
        return [*parts, text[begin:]]

    def _group(self, texts: list[bytes], begins: list[bool]) -> list[np.ndarray]:
        """Ids of the texts; one that does not begin a text follows a space."""
        data = b" ".join(texts)
        array = np.frombuffer(data, np.uint8)
        spaces = np.flatnonzero(array == 32)
        starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(array))
        sizes = np.array([len(t) for t in texts])
        first = np.searchsorted(starts, np.cumsum(sizes + 1) - sizes - 1)
        heads = np.zeros(len(starts), bool)
        heads[first] = begins
        self.powers.need(len(array) + 1)
        total = np.zeros(len(array) + 1, np.uint64)
        np.cumsum((array.astype(np.uint64) + np.uint64(1)) * self.powers.up[: len(array)], out=total[1:])
        h = (total[ends] - total[starts]) * self.powers.down[starts]
        h = (h ^ (h >> np.uint64(31)) ^ (ends - starts).astype(np.uint64) << np.uint64(40)) * _MIX
        h = np.where(heads, h * _HEAD, h)
        h ^= h >> np.uint64(29)
        h = np.where(h == 0, np.where(heads, np.uint64(2), np.uint64(1)), h)
        slot = self.memo.slots(h)
        known = self.memo.keys[slot] == h
        self.memo.met[slot[known]] = True
        if not known.all():
            missing = np.flatnonzero(~known)
            new, at = np.unique(h[missing], return_index=True)
            if self.memo.n + len(new) > self.memo.places // 2:
                self.memo.renew()
                missing = np.flatnonzero(self.memo.keys[self.memo.slots(h)] != h)
                new, at = np.unique(h[missing], return_index=True)
            at = missing[at]
            self._learn([data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], new, heads[at])
            slot = self.memo.slots(h)
        n, begin = self.memo.sizes[slot].astype(np.int64), self.memo.starts[slot]
        after = np.cumsum(n)
        ids = self.memo.pool[np.repeat(begin - after + n, n) + np.arange(after[-1])]
        return np.split(ids, (after - n)[first[1:]])

    def ids(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text as little-endian integers of `dtype`; null is empty."""
        texts = [t or "" for t in texts]
        if not self.chunked:
            return self._plain(texts)
        out: list[np.ndarray] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if _UNSAFE.search(t)]
        for i, ids in zip(whole, self._plain([texts[i] for i in whole]), strict=True):
            out[i] = ids
        rest = [(i, part, k == 0) for i in range(len(texts)) if out[i] is None for k, part in enumerate(self._parts(texts[i].encode()))]
        group, size = [], 0
        for k, (_, part, _) in enumerate(rest):
            group.append(rest[k])
            size += len(part)
            if size >= GROUP_BYTES or k == len(rest) - 1:
                for (j, _, head), ids in zip(group, self._group([b for _, b, _ in group], [h for *_, h in group]), strict=True):
                    out[j] = ids if head else np.concatenate([out[j], ids])
                group, size = [], 0
        return out
