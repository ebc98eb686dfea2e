import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string, sig int, Words string, `rule` int, part int"


def sentence(rng, n, pool):
    return " ".join(rng.choices(pool, k=n))


@pytest.fixture(scope="session")
def rows():
    """Texts with nulls, empty and blank texts, copies, near copies, shared passages, very long and repetitive texts."""
    rng = random.Random(3)
    pool = {"en": ["the", "of", "and", "thing", "erend", "onhable", "Shore,", "ing."], "fr": ["le", "été", "où", "queçon", "éaux", "ment", "père.", "dans"]}
    passage = sentence(rng, 70, ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"])
    out = []
    for i in range(60):
        lang = ("en", "fr")[i % 2]
        own = [f"{w}{rng.randrange(40)}" for w in rng.choices(pool[lang], k=rng.randrange(30, 200))]
        text = " ".join(own)
        if i % 7 == 3:
            text = text[:200] + "\n" + passage + "\n" + text[200:]
        if i % 10 == 4:
            text += ' token = "%040x" password=%018x' % (rng.getrandbits(160), rng.getrandbits(72))
        out.append([i, text, lang])
    out[11][1] = out[10][1]  # copy
    out[12][1] = out[10][1] + " end"  # near copy
    out += [[60, None, "en"], [61, "", "en"], [62, " \t\n", None], [63, "x " * 9000, "en"], [64, "12 34 !!", "fr"], [65, "one", "en"],
            [66, "12 34 !! <|endoftext|> ok", None], [None, out[10][1], "en"], [67, out[5][1], "en"], [67, out[5][1], "en"], [68, "İΣ ς 中文 é́ \x1c\x85 a", "en"]]
    return [(i, t, lang, "src0", 0 if t is None else len(t), "clash", 1, "w", 2, 3) for i, t, lang in out]


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pickwise.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    from pickwise.llm.common import prepare
    prepare(spark)
    return spark.createDataFrame([], SCHEMA)
