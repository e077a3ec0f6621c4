"""Language identification: averaged embeddings of hashed byte n-grams under a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.llm.common import quoted

#: Each of the two n-gram lengths has 2**BUCKET_BITS embeddings of DIM numbers.
BUCKET_BITS, DIM = 14, 16
BUCKETS = 2 << BUCKET_BITS
#: The classifier is fitted on a sample of about this many documents of each language, chosen by a hash of id and text, and of about
#: SAMPLED in all, never over twice that; each language has one at least, so no more than SAMPLED languages are learned (those of most documents;
#: Model.left_out counts documents of others). Of a sampled document's distinct n-grams no more than KEPT_GRAMS go in, chosen by a hash
#: as well. That bounds what goes to the driver at 32 bytes * KEPT_GRAMS * SAMPLED.
SAMPLE_PER_LANGUAGE, SAMPLED, KEPT_GRAMS = 600, 12_000, 2048
#: Bytes looked at together.
SLICE = 1 << 18
NOT_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def grams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all 3- and 4-byte grams of the lower-cased text; a slice at a time."""
    raw = np.frombuffer(f" {text.lower()} ".encode(errors="replace").translate(NOT_LETTERS), np.uint8)
    for at in range(0, len(raw) - 2, SLICE):
        b = raw[at : at + SLICE + 3].astype(np.uint32)
        three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
        four = three[:-1] | b[3:] << 24
        shift = np.uint32(32 - BUCKET_BITS)
        yield np.concatenate([three * np.uint32(2654435761) >> shift, (four * np.uint32(2246822519) >> shift) + np.uint32(1 << BUCKET_BITS)])


@dataclass
class Model:
    languages: list[str]
    embeddings: np.ndarray  # of each bucket
    weights: np.ndarray  # by which a text's mean embedding gives each language's logit
    bias: np.ndarray
    temperature: float
    threshold: float
    left_out: int = 0

    @cached_property
    def scores(self) -> np.ndarray | None:
        """What each bucket adds to each language's logit, where that is no more numbers than its embedding."""
        return (self.embeddings @ self.weights).astype(np.float32) if len(self.languages) <= DIM else None

    def probabilities(self, text: str) -> np.ndarray:
        of = self.embeddings if self.scores is None else self.scores
        total, n = np.zeros(of.shape[1]), 0
        for h in grams(text):
            total += of.take(h, axis=0).sum(0, dtype=np.float64)
            n += len(h)
        mean = total / max(n, 1)
        return softmax(((mean @ self.weights if self.scores is None else mean) + self.bias) / self.temperature)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(labelled: DataFrame, per_language: int, most_languages: int = SAMPLED) -> tuple[list[tuple[str, np.ndarray, np.ndarray]], int]:
    """Bucket counts of about per_language different documents of each language, and how many are of languages too rare to be learned.

    Rows are drawn by a hash of id and text, so that neither null nor repeated ids share a draw; rows that are alike in both are one.
    """
    labelled = labelled.select("lang", "text", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", F.lit("sample")).alias("draw"))
    counted = labelled.select("lang", "draw").distinct().groupBy("lang").count()
    sizes = counted.orderBy(F.desc("count"), "lang").limit(most_languages).collect()
    if not sizes:
        return [], 0
    left_out = counted.agg(F.sum("count")).first()[0] - sum(r["count"] for r in sizes)
    each = min(per_language, max(1, SAMPLED // len(sizes)))
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1.0, each / r["count"])) for r in sizes], "lang string, share double")
    drawn = labelled.join(F.broadcast(shares), "lang").where(F.pmod("draw", F.lit(1_000_000)) < F.col("share") * 1_000_000)
    chosen = drawn.dropDuplicates(["lang", "draw"]).orderBy("draw", "lang").limit(2 * SAMPLED)

    def run(batches):
        for pdf in batches:
            rows = []
            for lang, draw, text in zip(pdf.lang, pdf.draw, pdf.text, strict=True):
                h, n = np.unique(np.concatenate([np.zeros(0, np.uint32), *grams(text)]), return_counts=True)
                if len(h) > KEPT_GRAMS:
                    few = np.sort(np.argsort(h * np.uint32(2654435761), kind="stable")[:KEPT_GRAMS])
                    h, n = h[few], n[few]
                rows.append((lang, draw, h.astype(np.int32), n.astype(np.int32)))
            yield pd.DataFrame(rows, columns=["lang", "draw", "h", "n"])

    found = chosen.mapInPandas(run, "lang string, draw long, h array<int>, n array<int>").toArrow()
    found = found.sort_by([("lang", "ascending"), ("draw", "ascending")]).combine_chunks()
    held = {c: found[c].combine_chunks() for c in ("h", "n")}
    parts = {c: (a.values.to_numpy(), a.offsets.to_numpy()) for c, a in held.items()}
    cut = lambda c, i: parts[c][0][parts[c][1][i] : parts[c][1][i + 1]]
    rows = [(lang, cut("h", i), cut("n", i)) for i, lang in enumerate(found["lang"].to_pylist())]
    return [r for r in rows if len(r[1])], left_out


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], *, epochs: int = 6, rate: float = 0.5, seed: int = 7, most_rejected: float = 0.001) -> Model:
    """Stochastic gradient descent over four fifths of the rows; the last fifth sets the temperature and the threshold.

    Every second step sees a short random draw of a document's n-grams, so that short texts are known as well. The
    threshold is where at most most_rejected of the right answers lie below, with half the odds; with fewer than 1 / most_rejected rows held out, with less.
    """
    languages = sorted({r[0] for r in rows})
    y = np.array([languages.index(r[0]) for r in rows], int)
    rng = np.random.default_rng(seed)
    e, w, b = rng.normal(0, 0.1, (BUCKETS, DIM)), rng.normal(0, 0.1, (DIM, len(languages))), np.zeros(len(languages))
    order = rng.permutation(len(rows))
    held, taken = order[: len(rows) // 5], order[len(rows) // 5 :]
    if not len(held):
        held = taken
    rarity = np.bincount(y[taken], minlength=len(languages)) if len(taken) else np.ones(len(languages))
    weight = len(taken) / np.maximum(1, rarity) / max(1, len(languages))
    steps, done = max(1, epochs * len(taken)), 0
    for _ in range(epochs):
        for i in rng.permutation(taken):
            h, n = rows[i][1], rows[i][2].astype(np.float64)
            if done % 2:
                h = rng.choice(h, min(40, len(h)), p=n / n.sum())
                n = np.ones(len(h))
            share = (n / n.sum())[:, None]
            mean = (e[h] * share).sum(0)
            error = softmax(mean @ w + b)
            error[y[i]] -= 1
            step = rate * (1 - done / steps) * min(weight[y[i]], 10)
            back = w @ error
            w -= step * np.outer(mean, error)
            b -= 0.1 * step * error
            np.subtract.at(e, h, step * share * back * 20)
            done += 1
    logits = np.array([(e[rows[i][1]] * (rows[i][2] / rows[i][2].sum())[:, None]).sum(0) @ w + b for i in held])
    heat = np.geomspace(0.05, 20, 80)
    # Laplace's rule: held-out rows that are all right don't show that the next one is; without it the smallest temperature wins, and every probability is 1
    due = (np.eye(len(languages))[y[held]] * len(held) + 1) / (len(held) + len(languages))
    loss = [-(due * np.log(softmax(logits / t) + 1e-12)).sum(1).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = softmax(logits / temperature)
    right = p.max(1)[p.argmax(1) == y[held]]
    # sums of probabilities are rounded: no threshold may come so near to 1 that a right answer can fall below it
    least = min(float(np.quantile(right, most_rejected, method="lower")), 1 - 1e-6) if len(right) else 0.0
    # the odds of p / (1 - p), halved, and lowered further where the rows held out are too few to show that quantile
    share = 0.5 * min(1.0, (len(right) * most_rejected) ** 0.5)
    threshold = least * share / (least * share + 1 - least) if least < 1 or share else 0.0
    return Model(languages, e.astype(np.float32), w, b, temperature, threshold)


def fit(docs: DataFrame, *, per_language: int = SAMPLE_PER_LANGUAGE, most_languages: int = SAMPLED) -> Model | None:
    """A model of the documents with text, a letter and lang; None where there are none."""
    rows, left_out = sample(docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")), per_language, most_languages)
    return replace(train(rows), left_out=left_out) if rows else None


def predictor(docs: DataFrame, model: Model | None):
    """A column function of text: struct(lang_pred, score, rejected)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            out = []
            for text in texts:
                if text is None or m is None:
                    out.append(("und", 0.0, True))
                    continue
                p = m.probabilities(text)
                k = int(p.argmax())
                out.append((m.languages[k], float(p[k]), bool(p[k] < m.threshold)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    def column(text: Column) -> Column:
        return predict(F.when(text.rlike(r"\p{L}"), text))

    return column


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs with lang_pred, score and rejected, from the whole text alone.

    A null text, one without a letter, or no model at all gives `und`, score 0 and rejected. The score is the calibrated
    probability; below the model's threshold a prediction counts as rejected. Columns of these names are replaced.
    """
    both = docs.select(F.struct(*(docs[quoted(c)].alias(str(n)) for n, c in enumerate(docs.columns))).alias("old"), predictor(docs, model)(docs["text"]).alias("new"))
    kept = [F.col(f"old.`{n}`").alias(c) for n, c in enumerate(docs.columns) if c not in ("lang_pred", "score", "rejected")]
    return both.select(*kept, "new.lang_pred", "new.score", "new.rejected")
