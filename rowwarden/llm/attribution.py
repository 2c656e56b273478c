"""Token counts by section: every document is encoded once, as a whole.

Counting sections one by one would encode them apart, and tokens that cross a boundary would be
counted twice or never exist. Here the tokens of the whole text are laid out by their character
spans and joined to the spans of the sections, both sorted. A token that crosses a boundary goes
to the section that holds its first character; so the counts of a document's sections add up to
its tokens exactly.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowwarden.llm.base import filled, query, slices, table, worker_state
from rowwarden.llm.tokens import vocabulary

TOKENIZER = "byte_bpe_50k.tiktoken"
COLUMNS = "doc_id long, section int, start long, n_chars long, n_tokens long, n_crossing long"
NAMES = ["doc_id", "section", "start", "n_chars", "n_tokens", "n_crossing"]


class Encoder:
    """A byte-level tokenizer with the length in bytes of each of its tokens."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("sections", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    @classmethod
    def of(cls, name: str) -> Encoder:
        path = vocabulary(name)
        return worker_state(f"bytes:{path}", lambda: cls(path))

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First byte of every token and the byte after its last."""
        ids = np.array(self.encoding.encode_ordinary(text), np.int64)
        ends = np.cumsum(self.size[ids])
        return ends - self.size[ids], ends


def lines(raw: bytes) -> np.ndarray:
    """First byte of every line; a line's break belongs to it. A text has a line more than breaks."""
    octets = np.frombuffer(raw, np.uint8)
    return np.concatenate(([0], np.flatnonzero(octets == 10) + 1))


def attributed(text: str, encoder: Encoder, sections: np.ndarray | None = None) -> np.ndarray:
    """Rows (start, characters, tokens, crossing tokens) of a text's sections.

    ``sections`` are the first characters of the sections, ascending from 0; lines by default."""
    raw = text.encode("utf-8", "replace")
    leading = (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80  # first bytes of characters
    if sections is None:
        begin = lines(raw)
    else:
        begin = np.append(np.flatnonzero(leading), len(raw))[sections]
    first, end = encoder.spans(text)
    # the character that holds a token's first byte decides; boundaries lie between characters
    owner = np.searchsorted(begin, first, side="right") - 1
    crossing = end > np.append(begin[1:], len(raw))[owner]
    characters = np.concatenate(([0], np.cumsum(leading)))
    start = characters[begin]
    return np.column_stack([
        start, np.diff(np.append(start, characters[-1])), np.bincount(owner, minlength=len(begin)),
        np.bincount(owner[crossing], minlength=len(begin))]).astype(np.int64)


def _attribute(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in slices(batches, "text"):
            rows = [attributed(text, encoder) for text in filled(batch, "text").to_pylist()]
            counts = np.fromiter(map(len, rows), np.int64, len(rows))
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            values = np.concatenate(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(np.repeat(np.arange(len(rows)), counts))), pa.array(number, pa.int32()),
                 *[pa.array(values[:, k]) for k in range(4)]], NAMES)
    return run


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, section, start, n_chars, n_tokens, n_crossing) for every line of every document.

    ``section`` counts a document's lines from 0, ``start`` is its first character; a line holds its
    own break. ``n_crossing`` of its tokens end in a later line. A null or empty text has one line
    without tokens. Special tokens' strings are ordinary text. Repeated rows are counted alike, null
    ids stay null; other columns are not read; an empty table gives no rows."""
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return texts.mapInArrow(_attribute(tokenizer), COLUMNS)


@query("op4_token_counts")
def op4(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"))
