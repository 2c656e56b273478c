"""URL filter and quality rules against plain Python, on awkward rows."""

import random
import re

from rowwarden.llm import quality, urls
from tests.llm.conftest import rows_of


def plain_url(url, rules):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda c: c[0].lower(), found[1]), found[2]) if found else ("", "")
    best = max(((len(h + p), len(h), h + p, v) for h, p, v in rules
                if (host == h or host.endswith("." + h)) and path.startswith(p)), default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def test_urls_match_plain_rules(spark):
    rng = random.Random(3)
    hosts = ["com", "a.com", "b.a.com", "x,a.com", "a..com", ".com", "org", "net", "A.Com", "com:80", "😀.com", ""]
    paths = ["", "/", "/e", "/en/", "/en/x", "/en/x/y", "//en", "/é", "/EN/"]
    rules = sorted({(rng.choice(hosts[:8]).lower(), rng.choice(paths), rng.choice(["allow", "block"])) for _ in range(25)})
    rules = list({(h, p): (h, p, v) for h, p, v in rules}.values())
    names = [f"{s}{h}{p}{t}" for s in ("http://", "https://u@", "//", "a://b://") for h in hosts for p in paths for t in ("", "?q=/x://", "#f")]
    pages = [(n, name) for n, name in enumerate(names)] + [(None, None), (0, names[0]), (-1, "")]
    table = spark.createDataFrame([(i, u, "x") for i, u in pages], "page_id long, url string, stack string")
    found = urls.judge(table, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert rows_of(found) == sorted(((i, *plain_url(u, rules)) for i, u in pages), key=repr)


def test_urls_without_pages_or_rules(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (2, None)], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert rows_of(urls.judge(pages, none)) == [(1, "a.com", "/x", None, "allow"), (2, "", "", None, "allow")]
    rules = spark.createDataFrame([(None, "/x", "block"), ("", None, "block"), ("com", None, "block")], none.schema)
    assert rows_of(urls.judge(pages, rules))[0] == (1, "a.com", "/x", "com", "block")
    assert urls.judge(pages.limit(0), rules).collect() == []


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:], strict=False))
    counts = {g: grams.count(g) for g in set(grams)} if len(grams) < 5000 else None
    covered = set(range(len(words))) if counts is None else set()
    for n, g in enumerate(grams if counts else []):
        if counts[g] > 1:
            covered |= {n, n + 1, n + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))


def test_quality_measures(spark, awkward):
    found = {(row["doc_id"], row["n_words"]): tuple(row)[1:] for row in quality.judge(awkward).collect()}
    assert quality.judge(awkward).count() == awkward.count()
    for row in awkward.collect():
        want = plain_measures(row["text"])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert found[(row["doc_id"], want[0])][:6] == (*want, failed)


def test_hosts_decide_on_failing_documents_only(documents):
    good = " ".join(f"w{n}" for n in range(60))
    rough = " ".join(f"w{n}##" for n in range(60))  # passes the base rules, not the symbol rule
    rows = [(n, "short", "en", "bad") for n in range(40)] + [(100, good, "en", "bad"), (101, rough, "en", "bad")]
    rows += [(200 + n, good, "en", "fine") for n in range(40)] + [(300, rough, "en", "fine"), (301, good, "en", None)]
    docs = documents(*rows)
    kept = {row["doc_id"] for row in quality.judge(docs).filter("kept").collect()}
    assert kept == {100, 300, 301, *range(200, 240)}
    whole = quality.kept_documents(docs)
    assert whole.columns == docs.columns and {row["doc_id"] for row in whole.collect()} == kept


def test_quality_of_nothing(nothing):
    assert quality.judge(nothing).collect() == [] and quality.kept_documents(nothing).collect() == []


def test_kept_documents_with_clashing_columns(awkward):
    kept = quality.kept_documents(awkward)
    assert kept.columns == awkward.columns and kept.collect() == []  # all short or repetitive
