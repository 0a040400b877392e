"""Token ids of many texts at once: texts are cut where every tokenizer of this kind cuts, equal cuts are encoded once.

The splitting pattern of byte-level BPE always cuts where white space begins. Batches of texts are cut
there, the cuts are dictionary-encoded, and only cuts that a worker has not met go to the encoder. The
memo is bounded; ids are gathered back with numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts that a worker remembers, and the characters up to which one is worth it.
MEMO, LONGEST = 300_000, 64
#: Runs of other characters with the white space before them; and white space that needs more care.
CHUNK, ODD = re.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+"), re.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def chunks(text: str) -> list[str]:
    """Cuts where the pattern cuts in any case: after a character that isn't white space, before one that is."""
    if not text:
        return []
    return [text] if not text.isascii() and ODD.search(text) or re.search(r"[\x0b\x0c\x1c-\x1f]", text) else CHUNK.findall(text)


def _marked(text: str) -> str:
    """The text with a NUL at each cut."""
    if "  " in text or "\n " in text or " \n" in text or "\t" in text or "\r" in text or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or ODD.search(text):
        return "\0".join(chunks(text))
    return text.replace(" ", "\0 ")


def packed(ids: Sequence[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit numbers."""
    return np.array(ids, dtype="<u4").tobytes() if len(ids) > 40 else b"".join([v.to_bytes(4, "little") for v in ids])


class BatchEncoder:
    """``encode_new``: from distinct cuts to their ids, packed. The memo has two halves; what is met again moves to the younger."""

    def __init__(self, encode_new: Callable[[pa.Array], Sequence[bytes]]):
        self.encode_new, self.young, self.old = encode_new, {}, {}

    def ids_of(self, cuts: pa.Array) -> list[bytes]:
        if len(self.young) > MEMO // 2:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        keys = cuts.to_numpy(zero_copy_only=False).tolist()
        out = list(map(young.get, keys))
        rest = [i for i, x in enumerate(out) if x is None]
        new = []
        for i, x in zip(rest, map(old.get, map(keys.__getitem__, rest)), strict=True):
            if x is None:
                new.append(i)
            else:
                out[i] = young[keys[i]] = x
        if new:
            for i, x in zip(new, self.encode_new(cuts.take(pa.array(new))), strict=True):
                out[i] = x
                if len(k := keys[i]) <= LONGEST:
                    young[k] = x
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where each text's ids begin (one more than texts)."""
        plain = [t if t and "\0" not in t else "" for t in texts]
        lists = pc.split_pattern(pa.array(map(_marked, plain), pa.large_string()), pattern="\0")
        coded = lists.flatten().dictionary_encode()
        unique = self.ids_of(coded.dictionary)
        flat = np.frombuffer(b"".join(unique), dtype="<u4")
        length = np.fromiter(map(len, unique), dtype=np.int64, count=len(unique)) // 4
        start = np.cumsum(length) - length
        code = coded.indices.to_numpy(zero_copy_only=False)
        n = length[code]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(start[code] - ends[:-1], n) + np.arange(ends[-1])]
        bounds = ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if any("\0" in t for t in texts):  # NUL is the mark: such a text goes to the encoder cut by cut
            rows = [np.frombuffer(b"".join(self.ids_of(pa.array(chunks(t), pa.large_string()))), dtype="<u4") if "\0" in t else ids[a:b] for t, a, b in zip(texts, bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            ids, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, bounds


def portions(texts: Sequence[str], most_chars: int = 5_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of rows with up to ``most_chars`` characters, or one row."""
    at, total = 0, 0
    for i, t in enumerate(texts):
        if i > at and total + len(t) > most_chars:
            yield at, i
            at, total = i, 0
        total += len(t)
    if at < len(texts):
        yield at, len(texts)
