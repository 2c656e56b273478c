"""The pipeline against its stages done plainly, one after the other."""

import random

import corpus_pipeline
from rowwarden.llm import language, packing
from tests.llm.conftest import DOCUMENTS
from tests.llm.test_duplicates import near, plain_fingerprint, plain_roots, plain_shingles
from tests.llm.test_models import SYLLABLES, spoken
from tests.llm.test_native import plain_measures


def corpus(rng):
    rows = []
    for n in range(160):
        lang = rng.choice(list(SYLLABLES))
        words = spoken(rng, SYLLABLES[lang], rng.choice([20, 80, 120])).split()
        if n % 9 == 0:
            words = words[:7] * 12
        if n % 10 == 3 and rows:
            words = rng.choice(rows)[1].split()
        if n % 17 == 5:
            words = [str(rng.randrange(10**6)) for _ in range(70)]
        rows.append((n, " ".join(words), lang, f"s{n % 3}", 0))
    items = [(n, spoken(rng, SYLLABLES["aa"], 12)) for n in range(5)]
    for n in (1, 4, 16):
        rows[n] = (n, rows[n][1] + " " + items[n % 5][1] + " " + spoken(rng, SYLLABLES["bb"], 60), "bb", "s1", 0)
    return rows, items


def test_pipeline(spark, tmp_path):
    rows, items = corpus(random.Random(8))
    spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    good = []
    for row in rows:
        n, _, _, _, repeated = plain_measures(row[1])
        if n >= 50 and 100 * repeated <= 50 * n:
            good.append(row)
    model = language.fitted(spark.createDataFrame(good, DOCUMENTS))
    texts = language.pa.array([row[1] for row in good])
    good = [row for row, score in zip(good, language.predict(texts, model)[1], strict=True) if score >= language.MIN_SCORE]
    prints = {row[0]: plain_fingerprint(row[1]) for row in good}
    roots = plain_roots(set(prints.values()), near)
    first = {}
    for row in good:
        first.setdefault(roots[prints[row[0]]], row)
    wanted = [plain_shingles(text) for _, text in items]
    clean = [row for row in first.values()
             if not any(5 * len(w & plain_shingles(row[1])) >= 4 * len(w) for w in wanted)]
    assert len(rows) > len(good) > len(first) > len(clean) > 0

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {row["doc_id"] for row in found} == {row[0] for row in clean}
    assert len({row["sequence_id"] for row in found}) == -(-sum(row["length"] for row in found) // packing.LIMIT)


def test_stages_keep_the_columns(spark, awkward, tmp_path):
    spark.createDataFrame([(1, "x y")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, awkward, str(tmp_path)).columns == awkward.columns, name
        assert stage(spark, awkward.limit(0), str(tmp_path)).collect() == [], name
