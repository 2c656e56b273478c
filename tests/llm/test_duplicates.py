"""SimHash classes, components and decontamination against brute force."""

import random

import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from rowwarden.llm import decontaminate, graph, simhash
from tests.llm.conftest import rows_of


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\x0b", " ").replace("\x0c", " ")
    words = [w for part in words.split(" ") for line in part.split("\n") for tab in line.split("\t") for w in tab.split("\r") if w]
    shingles = [" ".join(words[n:n + 3]) for n in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_roots(values, close):
    """Least member of every value's component, by walking."""
    root = {}
    for start in sorted(values):
        stack = [start] if start not in root else []
        while stack:
            at = stack.pop()
            if at not in root:
                root[at] = start
                stack += [other for other in values if other not in root and close(at, other)]
    return root


def near(a, b):
    return ((a ^ b) & (1 << 64) - 1).bit_count() <= 2


def test_fingerprints():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 7, 60):
        text = rng.choice(" \n\x0b").join(rng.choice(["The", "É", "ß x", "a,b", "😀"]) for _ in range(n))
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_links_keep_every_component(spark, monkeypatch):
    """Also with blocks so small that nearly all take the way without pairs."""
    rng = random.Random(2)
    values = {0, -1}
    for _ in range(6):
        at = rng.getrandbits(64) - (1 << 63)
        for _ in range(25):
            values.add(at)
            for bit in rng.sample(range(64), rng.choice([1, 2, 2, 3])):
                at ^= (1 << bit) if bit < 63 else -(1 << 63)
    want = plain_roots(values, near)
    prints = spark.createDataFrame([(n, v) for n, v in enumerate(sorted(values))], "doc_id long, fp long")
    for size in (64, 3):
        monkeypatch.setattr(simhash, "MAX_BLOCK", size)
        found = {row["fp"]: row["root"] for row in simhash.classes(prints).collect()}
        assert set(found) == values
        groups = {}
        for value, root in found.items():
            groups.setdefault(root, set()).add(value)
        wanted = {}
        for value, root in want.items():
            wanted.setdefault(root, set()).add(value)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_components(spark):
    chain = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 130)] + [(7, 7), (None, 3), (200, 100)]
    edges = spark.createDataFrame(chain, "u long, v long")
    found = dict(rows_of(graph.components(edges)))
    assert found == {**{n: 0 for n in range(41)}, **{n: 100 for n in range(100, 130)}, 200: 100}
    assert graph.components(edges.limit(0)).collect() == []


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    rows = [(row["doc_id"], plain_fingerprint(row["text"])) for row in awkward.collect()]
    roots = plain_roots({fp for _, fp in rows}, near)
    least = {}
    for doc_id, fp in rows:
        if doc_id is not None:
            least[roots[fp]] = min(doc_id, least.get(roots[fp], doc_id))
    want = sorted(((i, fp - (1 << 64) if fp >> 63 else fp, least.get(roots[fp])) for i, fp in rows), key=repr)
    assert rows_of(simhash.near_duplicates(awkward)) == want
    assert simhash.near_duplicates(nothing).collect() == []


def test_one_document_of_each_class_stays(awkward, nothing, documents):
    kept = simhash.distinct_documents(awkward)
    assert kept.columns == awkward.columns
    ids = [row["doc_id"] for row in kept.orderBy("doc_id").collect()]
    assert ids == [1, 2, 4, 6, 7]  # 3, 5 and the null are as empty as 2; 1 stays once
    assert simhash.distinct_documents(nothing).collect() == []
    # an id that names two texts keeps both; without any id one row of a class stays
    docs = documents((5, "one two three four"), (5, "five six seven eight"), (None, "nine ten eleven"), (None, "nine ten eleven"))
    assert [row["doc_id"] for row in simhash.distinct_documents(docs).orderBy("doc_id").collect()] == [None, 5, 5]


def plain_words(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()


def plain_shingles(text, size=5):
    words = plain_words(text)
    return {" ".join(words[n:n + size]) for n in range(len(words) - size + 1)}


def contamination_case(rng):
    items = [" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.choice([1, 3, 5, 9, 15, 40]))) for _ in range(40)] + [None, "", "w1"]
    docs = []
    for n in range(300):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([0, 3, 30, 400]))]
        for _ in range(rng.randrange(3)):
            item = (rng.choice(items) or "").split()
            for _ in range(rng.randrange(2)):
                if item:
                    item[rng.randrange(len(item))] = "X"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() if rng.random() < .5 else w for w in item]
        docs.append((n, rng.choice([" ", "\n"]).join(words)))
    docs += [(1000 + n, items[n]) for n in range(10)] + [(None, items[5]), (500, None), (501, "")]
    return docs, list(enumerate(items)) + [(None, items[3]), (3, items[3])]


def test_contained_items(spark, monkeypatch):
    docs, items = contamination_case(random.Random(5))
    want = []
    for doc_id, text in docs:
        for item_id, item in items:
            size = min(5, len(plain_words(item)))
            wanted, own = (plain_shingles(x, size) if size else set() for x in (item, text))
            if wanted and 5 * len(wanted & own) >= 4 * len(wanted):
                want.append((doc_id, item_id, len(wanted & own), len(wanted), len(wanted & own) / len(wanted)))
    assert len(want) > 50
    left = spark.createDataFrame([(*row, 1) for row in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(*row, 1) for row in items], "item_id long, text string, doc_id int")
    for size in (8_000_000, 300):  # one block of items, many blocks
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", size)
        assert rows_of(decontaminate.contained(left, right)) == sorted(want, key=repr)
        dirty = {row[0] for row in want}
        clean = [row["doc_id"] for row in decontaminate.clean_documents(left, right).collect()]
        assert sorted(clean) == sorted(n for n, _ in docs if n not in dirty and n is not None)
    assert decontaminate.contained(left.limit(0), right).collect() == [] == decontaminate.contained(left, right.limit(0)).collect()


def test_decontamination_of_awkward_rows(awkward, spark):
    items = spark.createDataFrame([(1, "the cat sat on the mat"), (2, "ok"), (3, "The CAT"), (4, "words the")], "item_id long, text string")
    found = rows_of(decontaminate.contained(awkward, items).select("doc_id", "item_id"))
    assert found == sorted([(1, 1), (1, 1), (None, 1), (4, 2), (1, 3), (1, 3), (None, 3), (6, 4)], key=repr)
    clean = decontaminate.clean_documents(awkward, items)
    assert clean.columns == awkward.columns and clean.filter(F.col("text").contains("cat")).count() == 0


def test_hash_tells_word_order():
    one = decontaminate.hashed(pa.array(["a", "b", "c", "d", "e"]), decontaminate.np.array([0, 5]))[0]
    two = decontaminate.hashed(pa.array(["e", "b", "c", "d", "a"]), decontaminate.np.array([0, 5]))[0]
    assert len(one) == len(two) == 1 and one[0] != two[0]


def test_hub_of_half_the_edges(spark, monkeypatch):
    """One vertex has half of all edges; it is matched by broadcast and the components are the same."""
    monkeypatch.setattr(graph, "MIN_HOT", 10)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        edges = [(5000, n) for n in range(1, 400)] + [(n, n + 1) for n in range(6000, 6400, 2)] + [(7000 + n, 7001 + n) for n in range(50)]
        found = dict(map(tuple, graph.components(spark.createDataFrame(edges, "u long, v long")).collect()))
        assert all(found[n] == 1 for n in [*range(1, 400), 5000]) and found[6001] == 6000 and found[7050] == 7000
        assert len(found) == 400 + 400 + 51
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
