"""Language identification: averaged hashed subword embeddings and a linear softmax.

A text is the mean of the embeddings of its byte pairs, triples and quadruples (hashed into a fixed number of
buckets), followed by one linear layer. Training is stochastic gradient descent in numpy (with per-weight step
sizes) over a bounded sample. A part of the sample is held back: it sets the softmax temperature and the score
below which a prediction is rejected, so that a stated share of the texts of known languages is let through.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from pickwise.llm.common import text_map

BUCKETS, DIM, EPOCHS, STEP = 1 << 15, 16, 6, 0.15
PER_LANGUAGE = 500  # bound of the training sample, rows of one language
LET_THROUGH = 0.999  # share of held-back texts whose prediction must not be rejected
CHUNK = 1 << 20
UNKNOWN = "und"


def grams(raw: bytes) -> np.ndarray:
    """Bucket of every byte pair, triple and quadruple."""
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 2:
        b = np.concatenate((b, np.full(2 - len(b), 32, np.uint32)))
    two = b[:-1] << np.uint32(8) | b[1:]
    three = two[:-1] << np.uint32(8) | b[2:]
    four = three[:-1] << np.uint32(8) | b[3:]
    shift = np.uint32(32 - 15)
    return np.concatenate([(g * np.uint32(m)) >> shift for g, m in ((two, 0x9E3779B1), (three, 0x85EBCA6B), (four, 0xC2B2AE35))])


def pieces(text: str):
    """Bytes of the lower-cased text in bounded pieces; neighbouring pieces share three bytes, so no quadruple is lost."""
    raw = b" " + text.lower().encode() + b" "
    for at in range(0, max(1, len(raw) - 3), CHUNK):
        yield raw[at : at + CHUNK + 3]


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


@dataclass
class Model:
    """table: buckets x languages (embedding times linear layer); empty when nothing was learned."""
    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for raw in pieces(text):
            g = grams(raw)
            total += self.table[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / n + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, score and whether the prediction is rejected."""
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0, True
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        score = float(min(1.0, p[k]))
        return self.languages[k], score, score < self.least


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], n_languages: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Embedding-by-layer table and bias from (buckets, shares, language) rows, which must come in a fixed order."""
    rng = np.random.default_rng(seed)
    e = rng.uniform(-1, 1, (BUCKETS, DIM)) / DIM
    w, b = rng.uniform(-1, 1, (DIM, n_languages)) / DIM, np.zeros(n_languages)
    ge, gw, gb = np.full(BUCKETS, 1e-10), np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(samples)):
            idx, share, y = samples[i]
            rows = e[idx]
            hidden = share @ rows
            d = softmax(hidden @ w + b)
            d[y] -= 1
            dh = w @ d
            step_w = np.outer(hidden, d)
            gw += step_w**2
            gb += d**2
            ge[idx] += (share * np.linalg.norm(dh)) ** 2
            e[idx] = rows - STEP * np.outer(share / np.sqrt(ge[idx]), dh)
            w -= STEP * step_w / np.sqrt(gw)
            b -= STEP * d / np.sqrt(gb)
    return (e @ w).astype(np.float32), b


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """Model from rows with text and language. Rows of a language are sampled by a hash of id and text to about ``per_language``.

    Null languages, null texts and texts without a letter teach nothing; with no row left nothing is learned. Any id will do,
    also none: the sample's order is that of the hash.
    """
    rows = docs.select(F.xxhash64(F.col(id_col).cast("bigint"), text_col).alias("drawn"), F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l")).where("t is not null and l is not null")
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[x for l, n in counts.items() for x in (F.lit(l), F.lit(min(1.0, per_language / n)))])
    code = F.create_map(*[x for i, l in enumerate(languages) for x in (F.lit(l), F.lit(i))])
    picked = rows.where(F.pmod("drawn", F.lit(1_000_000)) < share[F.col("l")] * 1_000_000)

    def features(coded):
        code, _, text = coded.partition(" ")
        if has_letter(text):
            total = np.zeros(BUCKETS)
            for raw in pieces(text):
                total += np.bincount(grams(raw), minlength=BUCKETS)
            idx = np.flatnonzero(total)
            yield int(code), idx.tolist(), (total[idx] / total.sum()).tolist()

    # the language travels before the text, so the rows need no second join
    keyed = picked.select(F.col("drawn").alias("k"), F.concat(code[F.col("l")].cast("string"), F.lit(" "), "t").alias("t"))
    got = text_map(keyed, "code int, idx array<int>, share array<float>", features, "k", "t").toArrow().sort_by([("k", "ascending"), ("code", "ascending")])
    idx, share_of = (got.column(c).combine_chunks() for c in ("idx", "share"))
    at, idx, share_of = idx.offsets.to_numpy(), idx.values.to_numpy(), share_of.values.to_numpy()
    samples = [(idx[a:b], share_of[a:b], k) for k, a, b in zip(got.column("code").to_pylist(), at, at[1:])]
    if not samples:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    held = [s for i, s in enumerate(samples) if i % 5 == 0]
    used = [s for i, s in enumerate(samples) if i % 5] or samples
    table, bias = train(used, len(languages))
    z = np.array([s @ table[i] + bias for i, s, _ in held])
    y = np.array([k for *_, k in held])

    def log_loss(t):
        p = np.exp(z / t - (z / t).max(axis=1, keepdims=True))
        return -np.log((p / p.sum(axis=1, keepdims=True))[np.arange(len(y)), y] + 1e-12).mean()

    temperature = float(min(np.geomspace(0.2, 5, 25), key=log_loss))
    top = np.array([softmax(r / temperature).max() for r in z])
    right = np.sort(top[z.argmax(axis=1) == y])
    # the bound never lies above an even chance between two languages
    least = float(min(0.5, right[int((1 - LET_THROUGH) * len(right))])) if len(right) else 0.0
    return Model(languages, table, bias, temperature, least)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row. Null text or text without a letter: 'und', 0, rejected."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return text_map(docs, "lang_pred string, score double, rejected boolean", lambda t: [shared.value.predict(t)], id_col, text_col)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose language is accepted, with the columns they came with; with nothing learned all with a letter."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def accepted(text):
        return not shared.value.predict(text)[2] if shared.value.languages else has_letter(text)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            yield batch.filter(pa.array([accepted(t) for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
