"""Quality and toxicity by co-training two views of a document.

The text view sees words, signs and repetition; the metadata view sees source, language, length
and layout. Both are logistic regressions over hashed binary features. In each round a view
labels the documents of an unlabelled pool that it is sure about, and the *other* view learns
from them. At the end each view is calibrated on labelled documents that nothing learned from,
and a small regression over both calibrated logits scores every document.

The models are fitted on a bounded sample: at most about ``LABELLED`` labelled and ``POOL``
unlabelled documents, drawn by a hash of ``doc_id`` (documented parameters). All documents are
scored, on their whole texts.

Edge cases: null and empty texts are scored as empty texts; null metadata is a value of its own.
Of repeated labels for a document the worst counts (quality 0, toxic 1); null labels count for
nothing. If a label has only one value in the sample, its score is constant (that share), and
without any label 1 for quality and 0 for toxicity, so that everything is kept. A null ``doc_id``
is scored but never learned from. Repeated rows are scored alike.
"""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from tillspark.llm.common import annotate, arrow_schema, in_groups, record, table, texts_of

LABELLED, POOL = 8_000, 6_000
ROUNDS = 3
SURE = 0.98
_BITS = 18
_SIGNS = re.compile(r"[^\w\s]")
_PUNCTUATION = string.punctuation


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) & ((1 << _BITS) - 1)


def _bucket(value: float) -> int:
    return int(np.log2(value + 1) * 2)


def text_view(text: str) -> np.ndarray:
    """Slots of the words, of the signs around them and of measures of repetition."""
    counts = Counter(text.lower().split())
    total = sum(counts.values())
    found = {""}
    for word in counts:
        core = word.strip(_PUNCTUATION)
        found.add(core)
        if len(core) != len(word):
            found.add("sign " + word[len(core):] if word.startswith(core) else "sign around")
    most = max(counts.values(), default=0) / max(total, 1)
    found.add(f"most {int(most * 20)} {min(_bucket(total), 12)}")
    found.add(f"distinct {int(len(counts) / max(total, 1) * 20)} {min(_bucket(total), 16)}")
    return np.unique(np.fromiter(map(_slot, found), np.int64, len(found)))


def metadata_view(text: str, lang, source, n_chars) -> np.ndarray:
    """Slots of where the page comes from and how it is laid out."""
    size = len(text)
    lines = text.count("\n") + 1
    signs = len(_SIGNS.findall(text)) / max(size, 1)
    blanks = text.count(" ") / max(size, 1)
    found = {"", f"source {source}", f"lang {lang}", f"stated {_bucket(n_chars or 0)}",
             f"size {_bucket(size)}", f"lines {_bucket(lines)}", f"line {_bucket(size / lines)}",
             f"signs {int(signs * 100)}", f"blanks {int(blanks * 40)}"}
    return np.unique(np.fromiter(map(_slot, found), np.int64, len(found)))


class Sparse:
    """Rows of slots, flat."""

    def __init__(self, rows: list[np.ndarray]):
        self.sizes = np.array([len(r) for r in rows], np.int64)
        self.slots = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes

    def logits(self, weights: np.ndarray) -> np.ndarray:
        if not len(self.sizes):
            return np.zeros(0)
        return np.add.reduceat(weights[self.slots].astype(np.float64), self.starts)

    def take(self, which: np.ndarray) -> Sparse:
        edges = np.split(self.slots, self.starts[1:])
        return Sparse([edges[i] for i in which])


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def telling(rows: Sparse, labels: np.ndarray, deviations: float = 3.5) -> np.ndarray:
    """Slots that occur with one label further from chance than so many deviations.

    Words of one or two documents would else fit the sample and nothing beyond it.
    """
    size, share = 1 << _BITS, labels.mean()
    seen = np.bincount(rows.slots, minlength=size)
    hits = np.bincount(rows.slots, np.repeat(labels, rows.sizes), size)
    spread = np.sqrt(np.maximum(seen * share * (1 - share), 1e-9))
    kept = np.abs(hits - seen * share) >= deviations * spread
    kept &= seen >= 3
    kept[_slot("")] = True
    return kept


def fit(rows: Sparse, labels: np.ndarray, steps: int = 80, rate: float = 0.3,
        ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression over the telling slots, by gradient steps scaled for each slot."""
    size = 1 << _BITS
    kept = telling(rows, labels)
    owner = np.repeat(np.arange(len(labels)), rows.sizes)
    used = kept[rows.slots]
    slots, owner = rows.slots[used], owner[used]
    weights, history = np.zeros(size), np.full(size, 1e-8)
    for _ in range(steps):
        z = np.bincount(owner, weights[slots], len(labels))
        error = (_sigmoid(z) - labels) / len(labels)
        slope = np.bincount(slots, error[owner], size) + ridge * weights
        history += slope * slope
        weights -= rate * slope / np.sqrt(history)
    return weights.astype(np.float32)


def fit_dense(columns: np.ndarray, labels: np.ndarray, steps: int = 60) -> np.ndarray:
    """Small logistic regression with a ridge, by Newton steps; the first weight is the bias."""
    x = np.column_stack([np.ones(len(columns)), columns])
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = _sigmoid(x @ w)
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - labels) + 1e-2 * w)
    return w


def co_train(views: tuple[Sparse, Sparse], labels: np.ndarray, rounds: int = ROUNDS,
             sure: float = SURE) -> dict:
    """A model for one label. ``labels`` is 0, 1 or -1 (unlabelled); every fifth labelled row
    calibrates and is not learned from."""
    labelled = np.flatnonzero(labels >= 0)
    share = float(labels[labelled].mean()) if len(labelled) else None
    hold, learn = labelled[::5], np.delete(labelled, np.s_[::5])
    if len(labelled) < 20 or len(set(labels[learn])) < 2 or len(set(labels[hold])) < 2:
        return {"constant": share}
    pool = np.flatnonzero(labels < 0)
    truth = labels[learn].astype(float)
    lent = [(np.zeros(0, np.int64), np.zeros(0))] * 2
    weights, scale, logits = [None, None], [None, None], [None, None]
    for turn in range(rounds + 1):
        for v, rows in enumerate(views):
            extra, guess = lent[v]
            if weights[v] is None or len(extra):
                which = np.r_[learn, extra]
                weights[v] = fit(rows.take(which), np.r_[truth, guess])
                logits[v] = rows.logits(weights[v])
                scale[v] = fit_dense(logits[v][hold, None], labels[hold].astype(float))
        if turn == rounds or not len(pool):
            break
        for v in (0, 1):  # what a view is sure about teaches the other one
            p = _sigmoid(scale[v][0] + scale[v][1] * logits[v][pool])
            sure_of = (p >= sure) | (p <= 1 - sure)
            lent[1 - v] = pool[sure_of], (p[sure_of] > 0.5).astype(float)
    calibrated = np.column_stack([s[0] + s[1] * z for s, z in zip(scale, logits)])
    mix = fit_dense(calibrated[hold], labels[hold].astype(float))
    return {"constant": None, "weights": weights, "scale": scale, "mix": mix}


def combined(model: dict, views: tuple[Sparse, Sparse], count: int, empty: float) -> np.ndarray:
    if "weights" not in model:
        return np.full(count, empty if model["constant"] is None else model["constant"])
    z = model["mix"][0]
    for rows, weights, scale, part in zip(views, model["weights"], model["scale"],
                                          model["mix"][1:]):
        z = z + part * (scale[0] + scale[1] * rows.logits(weights))
    return _sigmoid(z)


def _views(batch) -> tuple[list, list]:
    texts = texts_of(batch, "text")
    names = batch.schema.names
    rest = [batch.column(n).to_pylist() if n in names else [None] * len(texts)
            for n in ("lang", "source", "n_chars")]
    return ([text_view(t) for t in texts],
            [metadata_view(t, *r) for t, *r in zip(texts, *rest)])


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED,
          pool: int = POOL) -> dict[str, dict]:
    """Models of both labels from a bounded sample; only slots of features reach the driver."""
    def draw(seed):
        return F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / F.lit(1 << 30)

    marks = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    n_marks, n_docs = max(marks.count(), 1), max(docs.count(), 1)
    marks = marks.where(draw("labelled") < labelled / n_marks)
    texts = docs.where(F.col("doc_id").isNotNull())
    texts = texts.select(*[c for c in ("doc_id", "text", "lang", "source", "n_chars")
                           if c in docs.columns])
    known = texts.join(F.broadcast(marks), "doc_id")  # about ``labelled`` rows of two numbers
    rest = texts.where(draw("pool") < pool / n_docs).join(F.broadcast(marks), "doc_id", "left_anti")
    sample = known.unionByName(rest, allowMissingColumns=True)
    output = "doc_id long, quality int, toxic int, words binary, layout binary"
    schema = arrow_schema(output)

    def slots(batches):
        for batch in in_groups(batches, "text"):
            words, layout = _views(batch)
            yield record(schema, batch.column("doc_id"), batch.column("quality"),
                         batch.column("toxic"), [w.astype(np.int32).tobytes() for w in words],
                         [w.astype(np.int32).tobytes() for w in layout])

    sample = sample.withColumns({"doc_id": F.col("doc_id").cast("long"),
                                 "quality": F.col("quality").cast("int"),
                                 "toxic": F.col("toxic").cast("int")})
    rows = sample.mapInArrow(slots, output).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["doc_id"], r["words"]))
    views = tuple(Sparse([np.frombuffer(r[c], np.int32).astype(np.int64) for r in rows])
                  for c in ("words", "layout"))
    mark = {c: np.array([-1 if r[c] is None else min(max(r[c], 0), 1) for r in rows], np.int64)
            for c in ("quality", "toxic")}
    return {c: co_train(views, mark[c]) for c in mark}


def score(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED,
          pool: int = POOL) -> DataFrame:
    """(row, quality_score, toxic_score, keep) of every document."""
    models = train(docs, labels, labelled, pool)

    def begin():
        def work(batch):
            views = tuple(Sparse(v) for v in _views(batch))
            good = combined(models["quality"], views, batch.num_rows, 1.0)
            toxic = combined(models["toxic"], views, batch.num_rows, 0.0)
            return good, toxic, (good >= 0.5) & (toxic < 0.5)
        return work

    return annotate(docs, "text", begin,
                    "quality_score double, toxic_score double, keep boolean")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, labels).where("keep").select("row.*")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, table(spark, sf_dir, "labels"))
    return scored.select("row.doc_id", "quality_score", "toxic_score", "keep")
