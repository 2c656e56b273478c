"""Packing, token attribution and lattice scores against the tokenizers and brute force."""

import math
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from rowwarden.llm import attribution, lattice, packing
from rowwarden.llm.tokens import WordEncoder, token_ids, vocabulary
from tests.llm.conftest import rows_of

TEXTS = ["", " ", "The cat's ＣＡＴ 12.5%", "<|endoftext|> a", "x<|STARTOFTEXT|>y", "é é ́x ΣΑΣ İ", "a b\x0bc d",
         "😀😀 ñ!?… don't", "<|", "a" * 300, "ab\n\n\ncd \n ef", "word " * 500]


@pytest.fixture(scope="module")
def tokenizers():
    from tokenizers import Tokenizer

    return {name: Tokenizer.from_file(vocabulary(name)) for name in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def test_token_ids_are_the_tokenizers(tokenizers):
    encoder = WordEncoder(vocabulary("word_bpe_49k.json"))
    for _ in range(2):  # the second time from memory
        ids, offsets = token_ids(pa.array(TEXTS), encoder, 1)
        for n, text in enumerate(TEXTS):
            want = tokenizers["word_bpe_49k.json"].encode(text, add_special_tokens=False).ids + [1]
            assert ids[offsets[n]:offsets[n + 1]].tolist() == want, text


def exact_fewest(lengths, limit):
    """Least number of bins, by trying all groups that hold the first piece."""
    if not lengths:
        return 0
    first, rest = lengths[0], lengths[1:]
    best = len(lengths)
    for k in range(len(rest) + 1):
        for group in combinations(range(len(rest)), k):
            if first + sum(rest[n] for n in group) <= limit:
                best = min(best, 1 + exact_fewest([x for n, x in enumerate(rest) if n not in group], limit))
    return best


def test_completion_is_optimal_on_small_cases():
    rng = random.Random(4)
    for _ in range(40):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        found = packing.complete(dict(Counter(lengths)), 20)
        used = Counter()
        for filling, times in found:
            assert sum(x * k for x, k in filling) <= 20
            used.update({x: k * times for x, k in filling})
        assert used == Counter(lengths)
        assert sum(n for _, n in found) == exact_fewest(lengths, 20)
    assert packing.complete({}, 20) == []


def test_completion_varies_the_greater_lengths(caplog):
    for seed in range(3):
        rng = random.Random(seed)
        lengths = []
        for _ in range(60):  # full sequences of two or three pieces
            cuts = sorted(rng.sample(range(1, 4096), rng.choice([2, 3]) - 1))
            lengths += [b - a for a, b in zip([0, *cuts], [*cuts, 4096], strict=True)]
        counts = dict(Counter(lengths))
        assert sum(n for _, n in packing.best_fit_decreasing(counts, 4096)) > 60
        with caplog.at_level("INFO", packing.__name__):
            assert sum(n for _, n in packing.complete(counts)) == 60
        assert "lower bound is 60, reached" in caplog.messages[-1]
    many = np.zeros(4097, np.int64)
    many[3] = 5000
    assert packing.fillings(many, 4096) == [(1, {3: 1365})]  # more pieces than steps


def test_completion_beats_best_fit():
    counts = {44: 2, 24: 4, 22: 4, 21: 2, 17: 2, 8: 3, 6: 6}  # best fit opens more than the bound
    bound = -(-sum(x * n for x, n in counts.items()) // 61)
    assert sum(n for _, n in packing.complete(counts, 61)) <= sum(n for _, n in packing.best_fit_decreasing(counts, 61))
    assert sum(n for _, n in packing.complete(counts, 61)) >= bound


def check_packing(rows, want, limit):
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= limit
    return len(by_sequence)


def wanted_pieces(tokenizers, rows, limit):
    out = []
    for doc_id, text in rows:
        ids = tokenizers["word_bpe_49k.json"].encode(text or "", add_special_tokens=False).ids + [1]
        for n, start in enumerate(range(0, len(ids), limit)):
            part = ids[start:start + limit]
            out.append((doc_id, n, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return out


def test_pack(documents, awkward, nothing, tokenizers):
    rows = [(n, " ".join(["word"] * k)) for n, k in enumerate([0, 0, 0, 1, 5, 15, 16, 40, 99, *[7] * 60])] + [(900, None)]
    found = packing.pack(documents(*rows).repartition(5), limit=16).collect()
    want = wanted_pieces(tokenizers, rows, 16)
    assert check_packing(found, want, 16) == -(-sum(x[3] for x in want) // 16)
    assert packing.pack(nothing).collect() == []
    numbered = awkward.filter("doc_id is not null")
    check_packing(packing.pack(numbered).collect(), wanted_pieces(tokenizers, [(r["doc_id"], r["text"]) for r in numbered.collect()], 4096), 4096)
    assert packing.pack(awkward).filter("doc_id is null").count() == 2


def test_attribution_matches_offsets(tokenizers, documents, awkward, nothing):
    encoder = attribution.Encoder(vocabulary("byte_bpe_50k.tiktoken"))
    plain = tokenizers["byte_bpe_50k.json"]
    plain.encode_special_tokens = True
    for text in TEXTS:
        spans = plain.encode(text, add_special_tokens=False).offsets
        starts = [0, *[n + 1 for n, c in enumerate(text) if c == "\n"]]
        owners = [sum(s <= a for s in starts) - 1 for a, _ in spans]
        crossing = [o + 1 < len(starts) and b > starts[o + 1] for o, (_, b) in zip(owners, spans, strict=True)]
        want = [[s, (starts + [len(text)])[n + 1] - s, owners.count(n), sum(c and o == n for o, c in zip(owners, crossing, strict=True))]
                for n, s in enumerate(starts)]
        assert attribution.attributed(text, encoder).tolist() == want, text
    halves = attribution.attributed("ab cd\nef", encoder, np.array([0, 1, 4]))
    assert halves[:, :2].tolist() == [[0, 1], [1, 3], [4, 4]] and halves[:, 2].sum() == attribution.attributed("ab cd\nef", encoder)[:, 2].sum()
    found = attribution.token_counts(awkward)
    assert found.count() == awkward.count() + 1 + 1  # one text has a line break, so has " \t\n "
    assert attribution.token_counts(nothing).collect() == []
    assert rows_of(attribution.token_counts(documents((1, None), (None, "")))) == sorted([(1, 0, 0, 0, 0, 0), (None, 0, 0, 0, 0, 0)], key=repr)


def plain_marginal(word, probability):
    """All segmentations, one by one."""
    word = lattice.MARK + word
    total = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            p = probability.get(piece, 0.0)
            if end - start == 1 and piece not in probability:
                p = probability[None] ** len(piece.encode())
            total[end] += total[start] * p
    return total[-1]


def test_lattice_sums_all_segmentations():
    pieces = lattice.Pieces.of(["▁", "▁a", "a", "b", "ab", "ba", "aba", "▁ab"])
    log_p = lattice.normalised(np.arange(len(pieces.pieces) + 2) + 1.0)
    probability = {piece: math.exp(log_p[2 + n]) for n, piece in enumerate(pieces.pieces)} | {None: math.exp(log_p[lattice.BYTE])}
    words = ["a", "ab", "abab", "x", "aéb", "b😀", "ab" * 30, "aba"]
    scores, expected = lattice.forward(pieces, log_p, words, np.ones(len(words)))
    assert np.allclose(scores, [math.log(plain_marginal(w, probability)) for w in words])
    # every character is covered once: pieces weighted by their lengths add up to all characters
    sizes = np.array([0, 0, *map(len, pieces.pieces)])
    assert np.isclose((expected * sizes).sum(), sum(len(w) + 1 for w in words) - 3) and np.isclose(expected[lattice.BYTE], 1 + 2 + 4)


def test_lm_scores(documents, awkward, nothing, spark):
    rng = random.Random(6)
    rows = [(n, " ".join(rng.choice(["The", "cat", "sat", "éa", "x,y", f"r{n}"]) for _ in range(rng.randrange(12)))) for n in range(60)]
    rows += [(7, "again again"), (7, "again again"), (None, "cat"), (1000, None)]
    found = {}
    for row in lattice.score(documents(*rows)).collect():
        found.setdefault(row["doc_id"], []).append(row)
    split = lambda text: "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    learned = [split(t) for i, t in rows if i is not None and not held(i)]
    counts = Counter(w for words in learned for w in words)
    n, v = sum(counts.values()) + len(learned), len(counts) + 1
    for i, text in rows:
        words = split(text)
        base = sum(math.log10((c + 1) / (n + v + 1)) for c in [*[counts[w] for w in words], len(learned)])
        assert any(r["n_tokens"] == len(words) + 1 and r["n_known"] == sum(w in counts for w in words) + 1 and r["held_out"] == held(i)
                   and r["train_tokens"] == n and math.isclose(r["base_score"], base) and r["score"] < 0 for r in found[i])
    assert lattice.score(nothing).collect() == []
    assert lattice.score(awkward).count() == awkward.count()
    alone = lattice.score(documents((None, "a b"))).first()
    assert alone["train_tokens"] == 0 and alone["n_known"] == 0 and math.isfinite(alone["score"])


def test_rare_words_take_the_join(documents, monkeypatch):
    rows = [(n, f"common common word{n % 5} only{n}") for n in range(30)]
    want = rows_of(lattice.score(documents(*rows)).select("doc_id", "n_known", "base_score"))
    monkeypatch.setattr(lattice, "HEAD", 1)
    got = rows_of(lattice.score(documents(*rows)).select("doc_id", "n_known", "base_score"))
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want])
