"""SentencePiece token ids by a prefix table, and their texts.

Byte-pair merges of a text are decided by neighbouring tokens alone: tokens are a text's encoding
exactly when each encodes to itself and every two neighbours, joined and encoded on their own,
give these two again. So a prefix's encoding is that of a shorter prefix and one last token, and
that token is unique. An automaton finds the vocabulary's tokens that end at a place; the
one that is compatible with the last token of the prefix before it is stored, and the ids are read
backwards from the end of the text.

No piece holds two characters that never stand side by side inside a piece, so a text is cut there and
each distinct segment is encoded once. A segment of any length takes time in proportion to it.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import filled, query, ragged, slices, table, worker_state
from rowwarden.llm.tokens import vocabulary

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
LOST = "\ufffd"  # stands for a byte that is no UTF-8
UNKNOWN_TEXT = " ⁇ "
SLICE = 1_500_000  # bytes of text encoded at once
KEPT_SEGMENTS = 200_000  # remembered per worker; others are encoded again when they return
KEPT_LETTERS = 64  # of a remembered segment at most
KEPT_PAIRS = 300_000
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class PieceEncoder:
    """Vocabulary of a SentencePiece BPE model with byte fallback and without text normalisation."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            proto.ParseFromString(file.read())
        rules = proto.normalizer_spec
        kinds = [piece.type for piece in proto.pieces]
        if (proto.trainer_spec.model_type != proto.trainer_spec.BPE or not proto.trainer_spec.byte_fallback
                or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix
                or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix
                or {USER_DEFINED, UNUSED} & set(kinds)):
            raise ValueError(f"{path}: only plain byte-pair models with byte fallback are supported")
        names = [piece.piece for piece in proto.pieces]
        self.names, self.kinds = names, kinds
        self.end = proto.trainer_spec.eos_id
        self.byte_ids = [0] * 256
        for n, kind in enumerate(kinds):
            if kind == BYTE:
                self.byte_ids[int(names[n][1:-1], 16)] = n
        normal = {names[n]: n for n, kind in enumerate(kinds) if kind == NORMAL}
        self.score = {name: proto.pieces[n].score for name, n in normal.items()}
        self.id_of = normal
        # only a piece that its own merges reach can be a token of a text
        self.split: dict[str, tuple[str, str]] = {}  # its last merge
        reached = [name for name in normal if len(name) == 1 or self.merged(name, self.split) == [name]]
        self.spines: dict[str, tuple | None] = {}
        self.automaton = ahocorasick.Automaton()
        for name in reached:
            if len(name) > 1:
                self.automaton.add_word(name, (name, len(name), {}))  # with what is known of tokens before it
        self.automaton.make_automaton()
        self.segment = self._segments(reached)
        self.known: dict[str, bytes] = {}
        self.room = KEPT_PAIRS
        self._surfaces()

    @classmethod
    def of(cls, name: str) -> PieceEncoder:
        path = vocabulary(name)
        return worker_state(f"pieces:{path}", lambda: cls(path))

    @staticmethod
    def _segments(names: list[str]) -> re.Pattern:
        """Finds the segments of a text: no piece reaches from one into the next."""
        longer = [name for name in names if len(name) > 1]
        if any(SPACE in name.lstrip(SPACE) for name in longer):
            return re.compile("(?s).+")
        body = "".join(sorted({re.escape(c) for name in longer for c in name} - {SPACE}))
        if not body:
            return re.compile(f"(?s){SPACE}+|.")
        return re.compile(f"(?s){SPACE}*[{body}]+|{SPACE}+|.")

    def merged(self, text: str, splits: dict | None = None) -> list[str]:
        """The pieces of a short text by merging: the best score first, of equal ones the leftmost.
        ``splits`` gets the merge that made the whole text, if one did."""
        parts: list[str | None] = list(text)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        score, heap = self.score, []

        def offer(left: int) -> None:
            right = after[left]
            if right < len(parts):
                value = score.get(parts[left] + parts[right])
                if value is not None:
                    heapq.heappush(heap, (-value, left, right, parts[left], parts[right]))

        for n in range(len(parts) - 1):
            offer(n)
        while heap:
            _, left, right, a, b = heapq.heappop(heap)
            if parts[left] != a or parts[right] != b or after[left] != right:
                continue
            parts[left], parts[right] = a + b, None
            if splits is not None and len(a) + len(b) == len(text):
                splits[text] = (a, b)
            after[left] = after[right]
            if after[right] < len(parts):
                before[after[right]] = left
            if before[left] >= 0:
                offer(before[left])
            offer(left)
        return [part for part in parts if part is not None]

    def _spine(self, token: str, side: int) -> list[tuple[str, float]] | None:
        """What stands at a token's left (0) or right (1) end while it is merged, each with the score of the
        merge that takes it up; None where scores do not fall from merge to merge."""
        steps, score = [(token, float("-inf"))], float("-inf")
        while token in self.split:
            if self.score[token] <= score:
                return None
            score = self.score[token]
            token = self.split[token][side]
            steps.append((token, score))
        return steps[::-1]

    def _ends(self, token: str) -> tuple:
        found = self.spines.get(token)
        if found is None:
            found = self.spines[token] = (self._spine(token, 0), self._spine(token, 1))
        return found

    def _untouched(self, left: str, right: str) -> bool | None:
        """Does no merge cross from ``left`` into ``right``? None where equal scores leave it open."""
        ends, starts = self._ends(left)[1], self._ends(right)[0]
        if ends is None or starts is None:
            return None
        i = j = 0
        while True:
            (a, taken_a), (b, taken_b) = ends[i], starts[j]
            crossing = self.score.get(a + b)
            if crossing is not None:
                if crossing > taken_a and crossing > taken_b:
                    return False
                if crossing in (taken_a, taken_b):
                    return None
            if i == len(ends) - 1 and j == len(starts) - 1:
                return True
            if taken_a == taken_b:
                return None
            if taken_a > taken_b:
                i += 1
            else:
                j += 1

    def compatible(self, left: str, right: str) -> bool:
        """May ``right`` follow ``left`` in an encoding? The merges at their common edge are followed; where
        equal scores make the order matter, both are merged anew."""
        found = self._untouched(left, right)
        return self.merged(left + right) == [left, right] if found is None else found

    def last_tokens(self, text: str) -> list[str]:
        """The prefix table: the last token of every non-empty prefix of a segment.

        A character that no longer candidate takes in is a token of its own, in the vocabulary or not."""
        last = list(text)
        decided = -1
        for end, (token, size, before) in self.automaton.iter(text):  # at one place the longest comes first
            if end == decided:
                continue
            start = end - size
            if start >= 0:
                previous = last[start]
                found = before.get(previous)
                if found is None:
                    found = self.compatible(previous, token)
                    if self.room > 0:
                        self.room -= 1
                        before[previous] = found
                if not found:
                    continue
            last[end] = token
            decided = end
        return last

    def encode_segment(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a segment, recovered from its end."""
        last, ids, place, known = self.last_tokens(text), [], len(text) - 1, self.id_of
        while place >= 0:
            token = last[place]
            n = known.get(token)
            if n is None:
                ids.extend([self.byte_ids[b] for b in reversed(token.encode())])
            else:
                ids.append(n)
            place -= len(token)
        ids.reverse()
        return pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str], end: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts and the offsets of each text's ids."""
        index: dict[str, int] = {}
        codes, counts = [], []
        find, place = self.segment.findall, index.setdefault
        for text in texts:
            found = find(SPACE + text.replace(" ", SPACE)) if text else []
            counts.append(len(found))
            codes += [place(segment, len(index)) for segment in found]
        known, parts = self.known, []
        for segment in index:
            ids = known.get(segment)
            if ids is None:
                ids = self.encode_segment(segment)
                if len(segment) <= KEPT_LETTERS and len(known) < KEPT_SEGMENTS:
                    known[segment] = ids
            parts.append(ids)
        if end:  # one more segment, behind each text
            bounds = np.cumsum(counts)
            codes = np.insert(np.array(codes, np.int64), bounds, len(parts))
            counts = np.array(counts, np.int64) + 1
            parts.append(np.array([self.end], "<u4").tobytes())
        codes = np.array(codes, np.int64)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        pool, starts = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        lengths = sizes[codes]
        ids = pool[ragged(starts[codes], lengths)]
        return ids.astype(np.int32), np.concatenate(([0], np.cumsum(lengths)))[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))]

    def _surfaces(self) -> None:
        """The bytes of every id, one after the other; control ids have none."""
        surface = []
        for name, kind in zip(self.names, self.kinds, strict=True):
            if kind == BYTE:
                surface.append(bytes([int(name[1:-1], 16)]))
            elif kind == CONTROL:
                surface.append(b"")
            else:
                surface.append((UNKNOWN_TEXT if kind == UNKNOWN else name.replace(SPACE, " ")).encode())
        self.sizes = np.array(list(map(len, surface)), np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.pool = np.frombuffer(b"".join(surface), np.uint8)
        kinds = np.array(self.kinds)
        self.control, self.byte = kinds == CONTROL, kinds == BYTE
        self.spaced = np.array([name.startswith(SPACE) for name in self.names]) & (kinds == NORMAL)

    def _repaired(self, ids: np.ndarray) -> str:
        """A text whose bytes may be broken: in each run of byte ids, a byte that begins no character is replaced."""
        out, run, first = [], bytearray(), True

        def close() -> None:
            place = 0
            while place < len(run):
                lead = run[place]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                try:
                    out.append(bytes(run[place:place + size]).decode())
                    place += size
                except UnicodeDecodeError:
                    out.append(LOST)
                    place += 1
            run.clear()

        for n in ids.tolist():
            raw = self.pool[self.starts[n]:self.starts[n] + self.sizes[n]].tobytes()
            if self.byte[n]:
                run += raw
            else:
                close()
                out.append(raw.decode()[1:] if first and self.spaced[n] else raw.decode())
            first = first and self.control[n]
        close()
        return "".join(out)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts of rows of ids. Where a row's first piece begins with the space that encoding put
        before the text, it goes; control ids are passed over."""
        given = ids
        n = len(offsets) - 1
        owner = np.repeat(np.arange(n), np.diff(offsets))
        control = self.control[ids]
        # a control id parts the bytes beside it, so a text with one among byte ids is put together piece by piece
        inner = control[:-1] & (owner[:-1] == owner[1:])
        odd = set(owner[:-1][inner].tolist()) & set(owner[self.byte[ids]].tolist())
        ids, owner = ids[~control], owner[~control]
        sizes, starts = self.sizes[ids], self.starts[ids]
        bounds = np.searchsorted(owner, np.arange(n + 1))
        some = bounds[:-1] < bounds[1:]
        first = bounds[:-1][some]
        cut = first[self.spaced[ids[first]]]
        starts[cut] += 1
        sizes[cut] -= 1
        data = self.pool[ragged(starts, sizes)]
        ends = np.concatenate(([0], np.cumsum(sizes)))[bounds]
        binary = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        if not odd:
            try:
                return binary.cast(pa.large_string()).cast(pa.string())
            except pa.ArrowInvalid:  # only byte ids can break a text
                pass
        rows = []
        for k, whole in enumerate(binary):
            try:
                text = whole.as_py().decode() if k not in odd else None
            except UnicodeDecodeError:
                text = None
            rows.append(self._repaired(given[offsets[k]:offsets[k + 1]]) if text is None else text)
        return pa.array(rows, pa.string())


def _rows(encoder: PieceEncoder, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    ids, offsets = encoder.encode(filled(batch, "text").to_pylist())
    return ids, offsets, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _rows(encoder, batch)[2]], ["doc_id", "ids"])
    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def encode(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids) for every row of ``docs`` (doc_id, text): the library's ids and the end id.

    A null text is empty; an empty text is the end id alone. Repeated rows are encoded alike, null ids
    stay null, other columns are not read; an empty table gives no rows. Texts of any length are
    encoded whole."""
    return _texts(docs).mapInArrow(_encoded(model), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in batches:
            lists = batch.column("ids")
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = encoder.decode(ids, np.concatenate(([0], np.cumsum(lengths))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, texts], ["doc_id", "ids", "text"])
    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text) for every row of ``encoded`` (doc_id, ids), the library's text of its ids.

    Null or no ids give an empty text; bytes that are no UTF-8 give U+FFFD each."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(model), "doc_id long, ids array<int>, text string")


def _coded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        for batch in slices(batches, "text", SLICE):
            ids, offsets, lists = _rows(encoder, batch)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists, encoder.decode(ids, offsets)], ["doc_id", "ids", "text"])
    return run


def round_trip(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, ids, text): ``decode(encode(docs))`` with one worker per task instead of two."""
    return _texts(docs).mapInArrow(_coded(model), "doc_id long, ids array<int>, text string")


@query("op12_sentencepiece")
def op12(spark, sf_dir):
    found = round_trip(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
