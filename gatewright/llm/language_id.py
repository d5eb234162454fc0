"""Language identification by string kernels.

The kernel of two texts is the cosine of their blended-spectrum presence vectors: which n-grams of 1 to 4 code points
(of the lower-cased text, runs of non-letters as one blank) occur at all. Landmarks drawn per language give Nyström
features K(x, Z) (K(Z, Z) + eps)^-1/2, and one ridge regression per language is fitted on them (kernel ridge regression
in the Nyström space). Prediction is two matrix products per batch.

N-grams are hashed into a table of PLACES bits, so the spectrum is that of the hashes; on whole documents of some
thousand distinct n-grams few share a place.

Training uses whole texts of every language: at most `per_language` rows of each, and at most about `most_rows` in all
(one row of each language at least): the rows with the smallest digests of their key. Both bounds are parameters.
Prediction reads every whole text.

Null or letterless texts are `und` with score 0. Rows whose label is null, and texts that are null or letterless, are
not learned from. Very long texts are hashed a part at a time, with the n-grams across the parts' borders. Without any row to learn from every text is `und`. Ties go to the alphabetically first language.
Repeated rows get equal predictions; extra columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewright.llm.common import remainder, table

UND = "und"
ORDERS = (1, 2, 3, 4)
#: Presence bits are kept in a table of this many places.
PLACES = 1 << 15
_OTHER = re.compile(r"[\W\d_]+")
#: Code points hashed at once.
_CHUNK = 1 << 20


def presence(text: str) -> np.ndarray:
    """Sorted places of the n-grams that occur in a text; empty if it has no letter."""
    plain = _OTHER.sub(" ", text.lower()).strip()
    if not plain or not any(c.isalpha() for c in plain):
        return np.empty(0, np.int64)
    points = np.frombuffer(f" {plain} ".encode("utf-32-le"), np.uint32)
    seen = np.zeros(PLACES, bool)
    for at in range(0, len(points), _CHUNK):
        part = points[at : at + _CHUNK + ORDERS[-1] - 1]
        h = np.zeros(len(part), np.uint32)
        for n in ORDERS:
            if len(part) < n:
                break
            h = (h[: len(part) - n + 1] + part[n - 1 :]) * np.uint32(2654435761)
            h ^= h >> np.uint32(13)
            seen[((h * np.uint32(n * 2 + 1)) >> np.uint32(17)).astype(np.int64)] = True
    return np.flatnonzero(seen)


@dataclass
class KernelModel:
    """Landmarks' unit presence vectors as columns, and weights from kernel values to one score per language."""

    languages: list[str]
    landmarks: np.ndarray  # PLACES x m, float32
    weights: np.ndarray  # m x languages
    bias: np.ndarray

    def kernel(self, places: list[np.ndarray]) -> np.ndarray:
        """Presence vectors (non-empty) against the landmarks."""
        lengths = np.array([len(p) for p in places])
        rows = np.zeros((len(places), PLACES), np.float32)
        for k, p in enumerate(places):
            rows[k, p] = 1
        return (rows @ self.landmarks) / np.sqrt(lengths)[:, None]

    def scores(self, places: list[np.ndarray]) -> np.ndarray:
        return self.kernel(places) @ self.weights + self.bias


def fit(found: list[tuple[np.ndarray, str]], landmarks: int, ridge: float = 1e-4, seed: int = 7) -> KernelModel:
    """Nyström kernel ridge regression, one language against the rest, on (presence vector, language) rows. Languages
    count alike, however many rows they have."""
    languages = sorted({y for _, y in found})
    if not found:
        return KernelModel([], np.zeros((PLACES, 0), np.float32), np.zeros((0, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    per = max(1, landmarks // len(languages))
    chosen: list[int] = []
    for lang in languages:
        own = [k for k, (_, y) in enumerate(found) if y == lang]
        chosen += [own[i] for i in rng.permutation(len(own))[:per]]
    z = np.zeros((PLACES, len(chosen)), np.float32)
    for col, k in enumerate(chosen):
        z[found[k][0], col] = 1 / np.sqrt(len(found[k][0]))
    model = KernelModel(languages, z, np.zeros((len(chosen), len(languages))), np.zeros(len(languages)))
    kernel = np.vstack([model.kernel([p for p, _ in found[a : a + 256]]) for a in range(0, len(found), 256)]).astype(float)
    values, vectors = np.linalg.eigh(kernel[chosen])
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0) + 1e-6)) @ vectors.T
    features = kernel @ root
    y = np.array([[1.0 if lang == of else -1.0 for lang in languages] for _, of in found])
    count = np.array([sum(of == lang for _, of in found) for lang in languages], float)
    weight = np.array([len(found) / (len(languages) * count[languages.index(of)]) for _, of in found])
    mean, bias = (features * weight[:, None]).sum(0) / weight.sum(), (y * weight[:, None]).sum(0) / weight.sum()
    centred = features - mean
    gram = centred.T @ (centred * weight[:, None]) + ridge * len(found) * np.eye(len(chosen))
    w = np.linalg.solve(gram, centred.T @ ((y - bias) * weight[:, None]))
    model.weights, model.bias = root @ w, bias - mean @ w
    return model


def sample(df: DataFrame, key: str, text: str, label: str, learn: Column, per_language: int, most_rows: int) -> list[tuple[np.ndarray, str]]:
    """Presence vectors and labels to learn from, PLACES bits each: of every language the rows with the smallest digests,
    at most per_language, and fewer where that times the languages is more than most_rows. Whole texts are read, and only
    of the rows whose digest is among the smallest of their language."""
    usable = df.where(learn & F.col(label).isNotNull() & F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(label).cast("string").alias("y"))
    counts = {r["y"]: r["count"] for r in usable.groupBy("y").count().collect()}  # one row a language
    if not counts:
        return []
    per_language = max(1, min(per_language, most_rows // len(counts)))
    digest = F.md5(F.coalesce(F.col("k").cast("string"), F.lit("")))
    u = F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
    share = F.create_map(*[F.lit(x) for y, n in counts.items() for x in (y, 4.0 * per_language / n)])
    drawn = usable.where(u < F.coalesce(F.element_at(share, F.col("y")), F.lit(0.0))).select("y", digest.alias("d"), "t")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for value in batch.column(2):
                row = np.zeros(PLACES, bool)
                row[presence(value.as_py())] = True
                packed.append(np.packbits(row).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["y", "d", "bits"])

    vectors = drawn.mapInArrow(bits, "y string, d string, bits binary").where(F.col("bits") != F.lit(bytes(PLACES // 8)))
    # about 4 * per_language rows of each language
    top = vectors.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy("d", "bits"))).where(F.col("n") <= per_language)
    rows = sorted((r["y"], r["d"], bytes(r["bits"])) for r in top.collect())
    return [(np.flatnonzero(np.unpackbits(np.frombuffer(b, np.uint8))), y) for y, _, b in rows]


def predict(df: DataFrame, key: str, text: str, model: KernelModel, lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the predicted language and a score from 0 to 1 (softmax of the languages' scores), in place of columns of
    these names."""
    df = df.drop(*[c for c in (lang, score) if c not in (key, text)])
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded: PLACES x landmarks
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes) + f", `{lang}` string, `{score}` double"
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            langs, scores = [UND] * batch.num_rows, [0.0] * batch.num_rows
            held: list[tuple[int, np.ndarray]] = []

            def flush(held=held, langs=langs, scores=scores) -> None:
                if held:
                    s = model.scores([p for _, p in held]) * 4
                    s = np.exp(s - s.max(1, keepdims=True))
                    s /= s.sum(1, keepdims=True)
                    for (k, _), best, row in zip(held, s.argmax(1).tolist(), s, strict=True):
                        langs[k], scores[k] = model.languages[best], float(row[best])
                    held.clear()

            for k, value in enumerate(batch.column(at)):
                places = presence(value.as_py() or "")
                if len(places) and model.languages:
                    held.append((k, places))
                    if len(held) == 128:
                        flush()
            flush()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, lang, score])

    return df.mapInArrow(run, schema)


def train(df: DataFrame, key: str, text: str, label: str, learn: Column, per_language: int = 250, landmarks: int = 160, most_rows: int = 50_000) -> KernelModel:
    return fit(sample(df, key, text, label, learn, per_language, most_rows), landmarks)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose crc32 remainder by 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = train(docs, "doc_id", "text", "lang", ~held_out)
    return predict(docs.select("doc_id", "text"), "doc_id", "text", model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
