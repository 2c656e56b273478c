"""Piece ids and texts against the library."""

import random
import time

import numpy as np
import pytest

from rowwarden.llm import pieces
from rowwarden.llm.tokens import vocabulary

MIXED = [*" ▁abcdehinrt'.,()\n\t\r;{}/*\"0é日本😀\x00ßİΣ", "the", "  ", "ing", " " * 12, "▁" * 15, "<s>", "<0x41>", "</s>", "﷽", "token"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary(pieces.MODEL))


@pytest.fixture(scope="module")
def encoder():
    return pieces.PieceEncoder(vocabulary(pieces.MODEL))


def rows(ids, offsets):
    return [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_ids_and_texts_are_the_librarys(encoder, library):
    rng = random.Random(3)
    texts = ["".join(rng.choices(MIXED, k=rng.randint(0, 40))) for _ in range(3000)]
    texts += ["", " ", "\n", *(" " * n + "a" for n in range(40)), *("a" + "\r" * n + " " * n for n in range(40))]
    for _ in range(2):  # the second time from memory
        ids, offsets = encoder.encode(texts, end=False)
        assert rows(ids, offsets) == library.encode(texts)
    assert encoder.decode(ids, offsets).to_pylist() == [library.decode(x) for x in library.encode(texts)]


def test_any_ids_are_decoded(encoder, library):
    rng = random.Random(8)
    space, byte = library.piece_to_id("▁"), encoder.byte_ids
    some = [space, *(byte[b] for b in (0xE6, 0x97, 0xA5, 0xED, 0xA0, 0x80, 0xF0, 0x9F, 0xC0, 0x41)), 0, 1, 2]
    cases = [[rng.choice(some) if rng.random() < 0.8 else rng.randrange(32_000) for _ in range(rng.randint(0, 12))] for _ in range(4000)]
    offsets = np.cumsum([0, *map(len, cases)])
    assert encoder.decode(np.array(sum(cases, []), np.int32), offsets).to_pylist() == [library.decode(x) for x in cases]


def test_prefix_table(encoder):
    text = "▁internationalisation"
    last = encoder.last_tokens(text)
    for n in range(1, len(text) + 1):
        assert last[n - 1] == encoder.merged(text[:n])[-1]


def test_compatible_pairs_merge_into_themselves(encoder):
    rng = random.Random(2)
    names = [name for name in encoder.id_of if len(name) == 1 or name in encoder.split]
    some = [(rng.choice(names), rng.choice(names)) for _ in range(20_000)]
    some += [(a, b) for a in names if set(a) == {"▁"} for b in rng.sample(names, 300)]
    some += [pair for name in rng.sample(names, 3000) for n in range(1, len(name)) if (pair := (name[:n], name[n:]))[0] in names and pair[1] in names]
    for pair in some:
        assert encoder.compatible(*pair) == (encoder.merged("".join(pair)) == list(pair)), pair


def test_time_grows_with_length(encoder, library):
    rng = random.Random(1)
    for text in ("".join(rng.choices("abcdefgh", k=400_000)), " " * 400_000, "a" * 400_000):
        start = time.perf_counter()
        ids, _ = encoder.encode([text], end=False)
        assert time.perf_counter() - start < 20
        assert ids.tolist() == library.encode(text)


def test_frames(spark, awkward, nothing, library):
    found = pieces.decode(pieces.encode(awkward)).collect()
    assert len(found) == awkward.count()
    want = sorted((r["doc_id"] or -1, library.encode(r["text"] or "") + [2]) for r in awkward.collect())
    assert sorted((r["doc_id"] or -1, r["ids"]) for r in found) == want
    assert all(r["text"] == library.decode(r["ids"]) for r in found)
    assert sorted(pieces.round_trip(awkward).collect(), key=repr) == sorted(found, key=repr)
    assert pieces.decode(pieces.encode(nothing)).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [2])], "doc_id long, ids array<int>")
    assert [r["text"] for r in pieces.decode(odd).collect()] == ["", "", ""]


def test_query_digests_whole_texts(spark, library, tmp_path, documents):
    import hashlib

    docs = [(1, "Hello  wörld\n日本"), (2, None), (3, ""), (4, "x " * 3000)]
    documents(*docs).write.parquet(str(tmp_path / "documents.parquet"))
    for row in pieces.op12(spark, str(tmp_path)).collect():
        ids = library.encode(dict(docs)[row["doc_id"]] or "") + [2]
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
