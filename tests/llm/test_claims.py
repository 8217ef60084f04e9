"""What the operators claim of production settings: fingerprints at their own number of samples, trees on suffixes never seen, pipeline stages that take effect."""

import math
import random
from collections import Counter

import numpy as np

from fleetlens.llm import common, fingerprints, url_filter


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randint(0, 5000)}" for _ in range(n)]


def test_fingerprints_of_sixteen_samples_estimate_without_bias(spark):
    """One pair's estimate is within four standard errors, and the mean over many pairs far nearer."""
    r = random.Random(2)
    flat, true = [], []
    for i in range(60):
        a = words(i, 200)
        b = a[: r.randint(0, 200)]
        b += words(1000 + i, 200 - len(b))
        flat += [" ".join(a), " ".join(b)]
        x, y = (Counter(zip(t, t[1:])) for t in (a, b))
        true.append(sum(min(x[k], y[k]) for k in x | y) / sum(max(x[k], y[k]) for k in x | y))
    made = fingerprints.fingerprint(spark.createDataFrame(list(enumerate(flat)), "doc_id long, text string"), ["doc_id"], "text")
    sig = {row["doc_id"]: row["sig"] for row in made.collect()}
    n = len(sig[0])
    assert n == 16
    found = [sum(p == q for p, q in zip(sig[2 * i], sig[2 * i + 1])) / n for i in range(len(true))]
    errors = np.array(found) - np.array(true)
    assert all(abs(e) <= 4 * math.sqrt(max(t * (1 - t), 0.02) / n) for e, t in zip(errors, true))
    assert abs(errors.mean()) < 3 * math.sqrt(0.25 / n / len(true))


def test_trees_judge_hosts_whose_suffix_they_never_saw(spark):
    """Blocked urls are long and full of digits and parameters, allowed ones short; hosts that no rule reaches have suffixes of their own."""
    r = random.Random(4)
    name = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(4, 9)))
    junk = lambda: "/" + "/".join(str(r.randint(10**5, 10**9)) for _ in range(r.randint(4, 7))) + "?" + "&".join(f"{name()}={r.randint(10**6, 10**9)}" for _ in range(r.randint(4, 8)))
    clean = lambda: f"/{name()}/{name()}.html"
    rows = [(f"https://{name()}.net{junk()}", "block") for _ in range(800)] + [(f"https://{name()}.org/fr{clean()}", "allow") for _ in range(800)]
    unseen = [(f"https://{name()}.{suffix}{junk() if bad else clean()}", "block" if bad else "allow") for suffix in ("shop", "dev", "museum") for bad in (True, False) for _ in range(60)]
    urls = [u for u, _ in rows + unseen]
    judged = {row["page_id"]: row for row in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    right = [judged[len(rows) + i]["verdict"] == want for i, (_, want) in enumerate(unseen)]
    assert all(judged[len(rows) + i]["rule"] is None for i in range(len(unseen))) and np.mean(right) > 0.85


def test_pipeline_stages_take_effect(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(6)
    own = "der die das und nicht ein haus baum strasse hund katze wasser brot licht".split()
    other = "the of and house tree street dog water bread light where under over again".split()
    text = lambda seed, vocabulary: ". ".join(" ".join(random.Random(seed * 100 + k).choices(vocabulary, k=12)) for k in range(10)) + "."
    docs = [(i, text(i, own if i % 2 else other), "de" if i % 2 else "en", ("a", "b")[i % 3 == 0]) for i in range(60)]
    docs += [(100, docs[5][1], "de", "a"), (101, docs[5][1] + " nachsatz", "de", "a"), (102, "the house and the tree", "en", "a"), (103, "the house and tree. " * 100, "en", "b"), (104, None, "en", "b"), (105, "12 34 !!", "en", "b")]
    r.shuffle(docs)
    where = str(tmp_path / "t")
    spark.createDataFrame([(k, t, lang, s, len(t or "")) for k, t, lang, s in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    kept, seen = spark.read.parquet(f"{where}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = common.stash(stage(spark, kept, where))
        seen[name] = Counter(row["doc_id"] for row in kept.select("doc_id").collect())
    assert not {104, 105} & set(seen["language"]) and {102, 103} <= set(seen["language"])
    assert not {102, 103} & set(seen["quality"]) and set(seen["language"]) - {102, 103} == set(seen["quality"])
    assert {5} == {5, 100, 101} & set(seen["near_duplicates"]) and len(seen["near_duplicates"]) == len(seen["quality"]) - 2
    copies = seen["mixing"]
    assert max(copies.values()) <= 2 and 1.3 < copies.total() / len(seen["near_duplicates"]) < 1.7
    packed = corpus_pipeline.run(spark, where).collect()
    starts = Counter(row["doc_id"] for row in packed if row["start"] == 0)
    assert starts == copies and all(row["length"] <= 2048 for row in packed)
    place = Counter()
    for row in sorted(packed, key=lambda x: (x["sequence_id"], x["offset"])):
        assert row["offset"] == place[row["sequence_id"]]
        place[row["sequence_id"]] += row["length"]
    assert max(place.values()) <= 2048
