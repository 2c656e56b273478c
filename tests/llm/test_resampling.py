"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rowwarden.llm import resampling
from tests.llm.conftest import rows_of

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {n: n + 32 for n in range(65, 91)}
TEXTS = ["", "a", " A-b_c9 É日本!x", "naïve\ncafé ẞ ΣΑΣ", "z" * 64 + " " + "y" * 65, "é" * 5000, "\x00\x7f", "one two three two one", "x" * 100_003]


def plain_words(text):
    return WORDS.findall((text or "").translate(LOWER))


def plain_features(text, run):
    words = plain_words(text)
    return [" ".join(words[n:n + k]) for k in range(1, run + 1) for n in range(len(words) - k + 1)]


def plain(docs, target, run=1, buckets=10_000, percent=10, least_words=20, seed=2024):
    bucket = lambda feature: zlib.crc32(feature.encode()) % buckets
    source = Counter(bucket(f) for _, text in docs for f in plain_features(text, run))
    wanted = Counter(bucket(f) for text in target for f in plain_features(text, run))
    s_all, t_all = sum(source.values()), sum(wanted.values())
    rows = []
    for doc_id, text in docs:
        found = plain_features(text, run)
        gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in map(bucket, found)]
        weight = sum(gain) // len(gain) if gain else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(found), weight, score, None, len(plain_words(text))])
    eligible = sorted((r for r in rows if r[5] >= least_words and r[3] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for n, row in enumerate(eligible[:percent * len(eligible) // 100], 1):
        row[4] = n
    return sorted((tuple(row[:5]) for row in rows), key=repr)


def test_checksums_of_spans():
    rng = random.Random(5)
    data = np.frombuffer(rng.randbytes(5000), np.uint8)
    spans = [(0, n) for n in (0, 1, 63, 64, 65, 127, 128, 129, 5000)]
    spans += [(a, rng.randint(0, min(300, 5000 - a))) for a in (rng.randrange(5000) for _ in range(300))]
    starts, lengths = map(np.array, zip(*spans, strict=True))
    want = [zlib.crc32(data[a:a + n].tobytes()) for a, n in spans]
    assert resampling.checksums(data, starts, lengths).tolist() == want
    assert resampling.checksums(data, starts[:0], lengths[:0]).tolist() == []


@pytest.mark.parametrize("run", [1, 2, 3])
def test_feature_buckets(run):
    found, first, n_words = resampling.feature_buckets(pa.array(TEXTS), run)
    assert n_words.tolist() == [len(plain_words(text)) for text in TEXTS]
    for n, text in enumerate(TEXTS):
        want = sorted(zlib.crc32(f.encode()) % 10_000 for f in plain_features(text, run))
        assert sorted(found[first[n]:first[n + 1]].tolist()) == want
    sliced = pa.array(TEXTS).slice(3, 2)
    assert resampling.feature_buckets(sliced, run)[2].tolist() == n_words[3:5].tolist()


@pytest.mark.parametrize(("run", "percent"), [(1, 10), (2, 37), (1, 0), (1, 100)])
def test_resample_equals_plain(spark, documents, run, percent):
    rng = random.Random(run)
    some = [f"w{n}" for n in range(40)] + ["Ünï", "X" * 70]
    docs = [(n % 90, " ".join(rng.choices(some, k=rng.randint(0, 60)))) for n in range(100)]
    docs += [(7, docs[7][1])] * 40 + [(None, docs[1][1] + " w1" * 30), (500, None), (501, "")]
    target = [" ".join(rng.choices(some[:10], k=30)), None, ""]
    frame = spark.createDataFrame([(n, t) for n, t in enumerate(target)], "item_id long, text string")
    found = resampling.resample(documents(*docs), frame, run=run, percent=percent)
    assert rows_of(found) == plain(docs, target, run=run, percent=percent)


def test_awkward_and_empty(spark, awkward, nothing):
    texts = spark.createDataFrame([("the cat",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in awkward.select("doc_id", "text").collect()]
    assert rows_of(resampling.resample(awkward, texts, percent=100, least_words=6)) == plain(rows, ["the cat"], percent=100, least_words=6)
    assert rows_of(resampling.resample(nothing, texts)) == []
    assert rows_of(resampling.resample(awkward, texts.limit(0))) == plain(rows, [])
    drawn = resampling.drawn_documents(awkward, texts, percent=100, least_words=1)
    assert drawn.columns == [*awkward.columns, "_rank"] and {r["doc_id"] for r in drawn.collect()} == {1, 4, 6, 7}
