"""Token ids of whole texts, computed once per distinct word.

The word tokenizer drops white space and never lets a token cross it, so the ids of a text are
the ids of its words one after the other. Words repeat, so each task encodes a word once and
gathers the rest with array operations. Texts that might spell a special token go through the
tokenizer whole.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rowwarden.llm.base import encoded, ragged, split_words, worker_state

SPECIAL = "<|"  # how special tokens begin
SEPARATOR = "<|startoftext|>"
KEPT_WORDS = 200_000  # remembered per worker; later words are encoded again when they return
CHUNK = 512


def vocabulary(name: str) -> str:
    """Path of a public tokenizer file; a path is taken as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of words by a tokenizer file; one per worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        self.known: dict[str, bytes] = {}

    @classmethod
    def of(cls, name: str) -> WordEncoder:
        path = vocabulary(name)
        return worker_state(f"words:{path}", lambda: cls(path))

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _new(self, words: Sequence[str]) -> list[bytes]:
        """Ids of unknown words; many words share a call, kept apart by a special token."""
        out: list[bytes] = []
        joined = [SEPARATOR.join(words[i:i + CHUNK]) for i in range(0, len(words), CHUNK)]
        for part in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False):
            ids = np.array(part.ids, "<u4")
            cuts = np.flatnonzero(ids == self.separator)
            starts, stops = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(ids)]))
            raw = ids.tobytes()
            out += [raw[4 * a:4 * b] for a, b in zip(starts.tolist(), stops.tolist(), strict=True)]
        return out

    def words(self, words: Sequence[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each word."""
        known = self.known
        ids = [known.get(word) for word in words]
        missing = [n for n, x in enumerate(ids) if x is None]
        if missing:
            fresh = self._new([words[n] for n in missing])
            for n, x in zip(missing, fresh, strict=True):
                ids[n] = x
            room = KEPT_WORDS - len(known)
            for n in missing[:max(0, room)]:
                known[words[n]] = ids[n]
        return ids


def token_ids(texts: pa.Array, encoder: WordEncoder, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All ids (32 bit) and the offsets of each text's ids; ``end`` is put after each text."""
    odd = pc.match_substring(texts, SPECIAL).to_numpy(zero_copy_only=False)
    plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
    flat, bounds = split_words(plain)
    words, codes = encoded(flat)
    parts = encoder.words(words)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    pool = np.frombuffer(b"".join(parts), "<u4")
    pool_starts = np.cumsum(sizes) - sizes
    lengths = sizes[codes] if len(codes) else np.empty(0, np.int64)
    ids = pool[ragged(pool_starts[codes], lengths)] if len(codes) else np.empty(0, "<u4")
    offsets = np.concatenate(([0], np.cumsum(lengths)))[bounds]
    if odd.any() or end is not None:
        tail = np.empty(0, "<u4") if end is None else np.array([end], "<u4")
        rows = []
        for n in range(len(texts)):
            own = encoder.whole(texts[n].as_py()) if odd[n] else ids[offsets[n]:offsets[n + 1]]
            rows += [own, tail]
        ids = np.concatenate(rows) if rows else np.empty(0, "<u4")
        sizes = np.array([len(x) for x in rows], np.int64).reshape(-1, 2).sum(1)
        offsets = np.concatenate(([0], np.cumsum(sizes)))
    return ids.astype("<u4", copy=False), offsets
