"""The five stages on small tables, and that the registered queries give whole results."""
import corpus_pipeline
import pytest

from pickwise.llm import queries
from pickwise.session import materialize


def stages(spark, docs):
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialize(stage(spark, out[-1], None), name))
    return out


def test_stages(spark, docs, rows):
    start, known, unique, cut, masked, packed = stages(spark, docs)
    for s in (known, unique, cut, masked):
        assert s.columns == docs.columns
    ids = [{r["doc_id"] for r in s.select("doc_id").collect()} for s in (start, known, unique, cut, masked, packed)]
    assert {60, 61, 62, 64}.isdisjoint(ids[1]) and set(range(60)) <= ids[1]
    assert 11 not in ids[2] and 10 in ids[2] and unique.where("doc_id = 67").count() == 0
    assert ids[2] == ids[3] == ids[4] == ids[5]
    texts = {r["doc_id"]: r for r in masked.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert "[SECRET]" in texts[4]["text"] and sum("alpha" in (r["text"] or "") for r in texts.values()) < 9
    assert packed.groupBy("doc_id").agg({"length": "sum"}).count() == len(ids[5])


def test_near_dedup_is_by_jaccard(spark):
    """Just the documents stay that no smaller kept one shares 0.8 of the five-word shingles with."""
    import random
    rng = random.Random(4)
    texts = []
    for i in range(30):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(3, 120))]
        texts.append(" ".join(own))
        for _ in range(rng.randrange(8)):  # chains of copies, each with a few other words or a tail
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
            own += [f"t{rng.randrange(10**6)}"] * rng.randrange(4)
            texts.append(" ".join(own))
    texts += [texts[0].upper(), "one", "one", "", None]
    rng.shuffle(texts)
    rows = list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (5, "another text of id five")]

    def parts(t):
        w = (t or "").lower().split()
        return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()

    kept = []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        s = parts(t)
        if not any(s == k or 5 * len(s & k) >= 4 * len(s | k) > 0 for _, k, _ in kept):
            kept.append((i, s, t))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None).collect()
    assert sorted((str(r[0]), sorted(parts(r[1]))) for r in got) == sorted([(str(i), sorted(s)) for i, s, _ in kept] + [("None", sorted(parts(texts[0])))])


@pytest.mark.parametrize("in_task,hub", [(50_000, 512), (40, 3)])
def test_near_dedup_of_chains_and_hubs(spark, monkeypatch, in_task, hub):
    """A long chain of texts, each like the next, and a large group of near copies: every document that goes has a kept smaller one like it."""
    import random
    from pickwise.llm import nearset
    monkeypatch.setattr(nearset, "IN_TASK", in_task)
    monkeypatch.setattr(nearset, "HUB", hub)
    monkeypatch.setattr(nearset, "PART", 16)
    rng = random.Random(6)
    n, m = (2000, 1500) if in_task > 100 else (60, 90)
    words = [f"c{i}" for i in range(n * 6 + 100)]
    texts = [" ".join(words[6 * i : 6 * i + 100]) for i in range(n)]  # a chain: neighbours share 90 of 102 shingles, those after them fewer
    base = [f"h{i}" for i in range(120)]
    for _ in range(m):
        own = list(base)
        own[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    rows = list(enumerate(texts))
    rng.shuffle(rows)

    def parts(t):
        w = t.split()
        return frozenset(hash(tuple(w[j : j + 5])) for j in range(len(w) - 4))

    kept = []
    for i, s in sorted((i, parts(t)) for i, t in rows):
        near = kept[-4:] if i < n else [k for k in kept if k[0] >= n]
        if not any(5 * len(s & k) >= 4 * len(s | k) for _, k in near):
            kept.append((i, s))
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), None)
    assert sorted(r["doc_id"] for r in got.collect()) == [i for i, _ in kept]


def test_near_dedup_searches_by_simhash(spark, monkeypatch):
    """Near copies within three bits are found by their SimHash fingerprints alone; what is linked but not similar stays."""
    from pyspark.sql import functions as F
    from pickwise.llm import nearset
    plain = nearset.sketches
    monkeypatch.setattr(nearset, "sketches", lambda *a: plain(*a).withColumn("keys", F.slice("keys", 1, 1)).withColumn("keys", F.transform("keys", lambda k: F.xxhash64("id"))))
    base = [f"s{i}" for i in range(4000)]
    texts = [" ".join(base), " ".join([*base[:-1], "other"]), " ".join(f"z{i}" for i in range(300))]
    assert bin(nearset.simhash.fingerprint(texts[0], 5) ^ nearset.simhash.fingerprint(texts[1], 5)).count("1") <= 3
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), None)
    assert sorted(r["doc_id"] for r in got.collect()) == [0, 2]


def test_stages_empty(spark, empty):
    assert stages(spark, empty)[-1].count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, name):
    import check
    sf = "/root/testdata/sf0.001"
    assert check.compare(queries.QUERIES[name](spark, sf), check.connect(sf), queries.ORACLES[name]) == ""


@pytest.mark.parametrize("name", ["op2_bpe_forced_boundaries", "op3_secret_forest", "op5_simhash_bit_sliced", "op6_ppm_score", "op7_language_id", "op9_decision_list", "op10_binary_packing"])
def test_whole_table(spark, name):
    sf = "/root/testdata/sf0.001"
    out = queries.QUERIES[name](spark, sf)
    if name != "op3_secret_forest":
        want = {r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id").collect()}
        assert {r["doc_id"] for r in out.select("doc_id").collect()} == want
    else:
        assert out.columns[0] == "doc_id"
