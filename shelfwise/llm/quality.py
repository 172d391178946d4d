"""Quality classifier by co-training two views of a document.

The content view sees the text: hashed byte pairs, signs and repetition. The metadata view sees source, lang, n_chars and the
page's layout in lines. Both start from labelled documents; in every round each view scores all other documents, and those it
is sure of become pseudo-labelled examples of the other view. Labelled documents that no fit has seen calibrate each view
and then the combination of both, which scores all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, functions as F

from shelfwise.llm.common import stored, texts
from shelfwise.llm.linear import Logistic, sigmoid

#: Most labelled documents used for fitting and calibration, and most pseudo-labels of a view and class in a round.
MAX_LABELLED, MAX_PSEUDO = 20_000, 2_000
ROUNDS, SURE = 3, 0.98
THRESHOLD = 0.5
#: A pseudo-label counts as this part of a label.
PSEUDO_WEIGHT = 0.5
PAIRS, SOURCES, LANGS = 256, 32, 16
SEED = 11
_SIGNS = (b"!", b"|", b"#", b"%", b"&", b"$", b"*")


def content_features(data: bytes) -> np.ndarray:
    """Root shares of hashed byte pairs, then shares of signs and of repeated words."""
    out = np.zeros(PAIRS + 8 + len(_SIGNS), np.float32)
    if data:
        raw = np.frombuffer(data, np.uint8)
        for at in range(0, len(raw), 1 << 22):  # a long text in pieces
            part = raw[at : at + (1 << 22) + 1].astype(np.uint16)
            out[:PAIRS] += np.bincount((part[:-1] * 31 + part[1:] * 17) % PAIRS, minlength=PAIRS)
            out[PAIRS] += ((part[: 1 << 22] >= 65) & (part[: 1 << 22] <= 90)).sum()
            out[PAIRS + 1] += ((part[: 1 << 22] >= 48) & (part[: 1 << 22] <= 57)).sum()
            out[PAIRS + 2] += (part[: 1 << 22] < 33).sum()
        out[:PAIRS] = np.sqrt(out[:PAIRS] / max(len(raw) - 1, 1))
        out[PAIRS : PAIRS + 3] /= len(raw)
        words = data.split()
        n = max(len(words), 1)
        out[PAIRS + 3] = len(set(words)) / n
        out[PAIRS + 4] = sum(map(eq, words, words[1:])) / n
        out[PAIRS + 5] = np.log1p(n) / 10
        out[PAIRS + 6] = np.log1p(len(data) / n)
        out[PAIRS + 7] = (1 - len(set(words)) / n) * np.log1p(n) / 10
        out[PAIRS + 8 :] = [min(data.count(s) / n, 4) for s in _SIGNS]
    return out


def meta_features(source: str | None, lang: str | None, n_chars: int | None, data: bytes) -> np.ndarray:
    """Hashed source and language, length, and the layout of the lines."""
    out = np.zeros(SOURCES + LANGS + 6, np.float32)
    out[zlib.crc32((source or "").encode()) % SOURCES] = 1
    out[SOURCES + zlib.crc32((lang or "").encode()) % LANGS] = 1
    breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    lengths = np.diff(np.concatenate([[-1], breaks, [len(data)]])) - 1
    out[-6] = np.log1p(max(n_chars or 0, 0)) / 10
    out[-5] = np.log1p(len(lengths)) / 5
    out[-4] = np.log1p(lengths.mean()) / 10
    out[-3] = np.log1p(lengths.max()) / 10
    out[-2] = (lengths < 30).mean()
    out[-1] = (lengths == 0).mean()
    return out


def _views(text: list[bytes], source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    content = np.array([content_features(t) for t in text], np.float32).reshape(len(text), -1)
    meta = np.array([meta_features(s, l, n, t) for t, s, l, n in zip(text, source, lang, n_chars)], np.float32)
    return content, meta.reshape(len(text), -1)


def _inputs(docs: DataFrame) -> list[Column]:
    """The columns the views read; one that the table lacks is null."""
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, content, meta): both views of every whole text as half-precision bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = [t or b"" for t in texts(batch.column(1))]
            views = _views(text, *(batch.column(i).to_pylist() for i in (2, 3, 4)))
            rows = [pa.array([v.astype(np.float16).tobytes() for v in view], pa.binary()) for view in views]
            yield pa.RecordBatch.from_arrays([batch.column(0), *rows], names=["doc_id", "content", "meta"])

    return docs.select(F.col("doc_id").cast("long"), *_inputs(docs)).mapInArrow(run, "doc_id long, content binary, meta binary")


def _matrix(column) -> np.ndarray:
    return np.array([np.frombuffer(x, np.float16) for x in column], np.float32)


class View:
    """A classifier of one view and its calibration."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> View:
        self.model = Logistic(penalty=5.0).fit(x, y, weight)
        self.scale = Logistic(penalty=0.1).fit(self.model.margin(held_x)[:, None], held_y)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.scale.margin(self.model.margin(x)[:, None])


class Model:
    """Both calibrated views and their combination; a constant if the labels show one class at most."""

    def __init__(self, constant: float | None = None):
        self.constant = constant
        self.content = self.meta = self.both = None

    def scores(self, content: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score, content view's and metadata view's probability of good quality."""
        if self.constant is not None or not len(content):
            same = np.full(len(content), self.constant if self.constant is not None else 0.5)
            return same, same, same
        views = np.clip(np.stack([self.content.margin(content), self.meta.margin(meta)], axis=1), -12, 12)
        return sigmoid(self.both.margin(views)), sigmoid(views[:, 0]), sigmoid(views[:, 1])


def _labelled(labels: DataFrame, limit: int) -> DataFrame:
    """(doc_id, quality): at most limit labelled documents, picked by a hash of doc_id; of conflicting labels the worst."""
    known = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("int").alias("quality"))
    count = known.count()
    place = F.xxhash64("doc_id", F.lit(SEED))
    share = F.pmod(place, F.lit(1 << 20)) < int((1 << 20) * min(1.0, 1.2 * limit / max(count, 1)))
    return known.where(share).orderBy(place, "doc_id").limit(limit)


def _pseudo(seen: DataFrame, model: Model, known: np.ndarray, limit: int) -> pd.DataFrame:
    """The documents that a view is sure of, at most about limit of each view and class: doc_id, content, meta, p_content,
    p_meta. Every document is scored; of those that are sure a share is picked by a hash of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            _, content, meta = model.scores(_matrix(batch.column(1).to_pylist()), _matrix(batch.column(2).to_pylist()))
            sure = [np.where(p >= SURE, 1, np.where(p <= 1 - SURE, 0, -1)) for p in (content, meta)]
            keep = np.flatnonzero(((sure[0] >= 0) | (sure[1] >= 0)) & ~np.isin(ids, known))
            taken = batch.take(pa.array(keep))
            columns = [*taken.columns, *(pa.array(s[keep].astype(np.int32)) for s in sure)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "meta", "by_content", "by_meta"])

    schema = "doc_id long, content binary, meta binary, by_content int, by_meta int"
    sure = seen.where("doc_id IS NOT NULL").mapInArrow(run, schema)
    counts = {(r[0], r[1]): r[2] for r in sure.groupBy("by_content", "by_meta").count().collect()}
    place = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30)) / float(1 << 30)
    wanted = F.lit(False)
    for at, name in enumerate(("by_content", "by_meta")):
        for label in (0, 1):
            count = sum(n for key, n in counts.items() if key[at] == label)
            if count:
                wanted |= (F.col(name) == label) & (place < limit / count)
    return sure.where(wanted).toPandas()


def fit(seen: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> Model:
    """The model fitted on features (doc_id, content, meta) and labels (doc_id, quality: 1 good, 0 bad).

    Fits use at most max_labelled labelled documents and 2,000 pseudo-labels of each view and class, both picked by a hash of
    doc_id from all there are; every document is scored in every round. Without both classes the model is constant: the
    class there is, or 0.5.
    """
    chosen = _labelled(labels, max_labelled)
    rows = seen.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).toPandas().sort_values("doc_id")
    y = rows["quality"].to_numpy(np.int64)
    if len(set(y)) < 2:
        return Model(float(y[0]) if len(y) else 0.5)
    content, meta, ids = _matrix(rows["content"]), _matrix(rows["meta"]), rows["doc_id"].to_numpy()
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in ids])
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held = np.ones(len(y), bool)  # too few labels to keep some apart
        train = held
    else:
        train = ~held
    model = Model()
    extra = pd.DataFrame({"content": [], "meta": [], "by_content": [], "by_meta": []})
    for turn in range(rounds + 1):
        for name, x, other in (("content", content, "by_meta"), ("meta", meta, "by_content")):
            more = extra[extra[other] >= 0]
            xs = np.vstack([x[train], _matrix(more[name])]) if len(more) else x[train]
            ys = np.concatenate([y[train], more[other].to_numpy(np.int64)])
            weight = np.concatenate([np.ones(train.sum()), np.full(len(more), PSEUDO_WEIGHT)])
            setattr(model, name, View().fit(xs, ys, weight, x[held], y[held]))
        views = np.clip(np.stack([model.content.margin(content[held]), model.meta.margin(meta[held])], axis=1), -12, 12)
        model.both = Logistic(penalty=0.5).fit(views, y[held])
        if turn < rounds:
            extra = _pseudo(seen, model, ids, MAX_PSEUDO)
    return model


def score_column(docs: DataFrame, model: Model) -> Column:
    """score, content_score and meta_score of each row of docs, from its whole text."""

    @F.pandas_udf("score double, content_score double, meta_score double")
    def scores(text: pd.Series, source: pd.Series, lang: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        clean = lambda s: [None if pd.isna(v) else v for v in s]
        views = _views([(t or "").encode() for t in clean(text)], clean(source), clean(lang), clean(n_chars))
        half = [v.astype(np.float16).astype(np.float32) for v in views]  # as the fit saw them
        return pd.DataFrame(dict(zip(("score", "content_score", "meta_score"), model.scores(*half))))

    return scores(*_inputs(docs))


def classify(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, content_score, meta_score, predicted, keep) of every row of docs: scores are probabilities of good
    quality, predicted is 1 and keep is true from 0.5.

    docs: doc_id, text and, where there are, source, lang, n_chars; labels: doc_id, quality. Null and empty texts, sources
    and languages are values like others; null labels and doc_ids take no part in fitting. Repeated rows come back as often;
    other columns are not read; empty docs give an empty result.
    """
    model = fit(stored(features(docs), "features"), labels, max_labelled)
    scored = docs.select(F.col("doc_id").cast("long"), score_column(docs, model).alias("s"))
    keep = F.col("s.score") >= THRESHOLD
    return scored.select("doc_id", "s.*", keep.cast("int").alias("predicted"), keep.alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The rows of docs that are not predicted bad, with the columns of docs."""
    model = fit(stored(features(docs), "features"), labels, max_labelled)
    return docs.withColumn("__s", score_column(docs, model)).where(F.col("__s.score") >= THRESHOLD).drop("__s")
