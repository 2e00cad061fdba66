"""Quality classifier by co-training: a content view and a metadata view teach each other."""

from __future__ import annotations

import json
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparquill.llm.common import importable, slices, staged
from sparquill.llm.toxicity import held_out

#: At most this many labelled rows of each class are learnt from (lowest hashed ids); unlabelled rows have no bound.
MOST_PER_CLASS = 3000
ROUNDS, SHARE, STEPS = 4, 0.05, 2
#: Log-odds are counted in this many bins over -LIMIT to LIMIT; a pseudo-label needs log-odds that
#: are SURE above the prior's or below.
BINS, LIMIT, SURE = 2400, 30.0, 2.0
SOURCES, LANGS, SIZES = 64, 16, 16
_CLASS = np.zeros(128, np.int8)
for _c in range(128):
    _s = chr(_c)
    _CLASS[_c] = 1 if _s.isupper() else 2 if _s.isdigit() else 3 if _s.isspace() else 4 if _s in "#*$%&|<>" else 5 if _s in "!?" else 6 if _s in ".,;:" else 7 if not _s.isalnum() else 0


def content_features(text: str) -> list[float]:
    """What the text alone shows: shares of kinds of characters, mean sizes and repetition of words and lines. How long
    the text is belongs to the other view."""
    n = len(text)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    kinds = np.bincount(_CLASS[points[points < 128]], minlength=8) / max(1, n)
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    count = max(1, len(words))
    return [
        *kinds[1:8].tolist(),
        float((points >= 128).sum()) / max(1, n),
        n / count / 10,
        len(set(words)) / count,
        max(Counter(words).values(), default=0) / count,
        sum(map(str.isupper, words)) / count,
        sum(w.islower() for w in words) / count,
        len(set(lines)) / max(1, len(lines)),
        sum(x.rstrip()[-1:] in ".!?\"'" for x in lines) / max(1, len(lines)),
        np.log1p(n / max(1, len(lines))),
    ]


def metadata_places(lang: str | None, source: str | None, n_chars: int | None) -> tuple[int, int, int]:
    """The three hot places of the page's metadata; null is a value of its own."""
    part = lambda x, m: 0 if x is None else 1 + zlib.crc32(x.encode()) % (m - 1)
    size = 0 if n_chars is None or n_chars < 0 else 1 + min(SIZES - 2, int(n_chars).bit_length() * 3 // 4)
    return part(lang, LANGS), LANGS + part(source, SOURCES), LANGS + SOURCES + size


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return x @ w[:-1] + w[-1]


def assigned(views: list[np.ndarray], history: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the view that labelled it (-1: none yet) and its pseudo-label, as the rounds so far went: in each,
    the views in turn label open rows whose log-odds are at or beyond that round's limits."""
    by, mark = np.full(len(views[0]), -1, np.int8), np.zeros(len(views[0]))
    for past in history:
        for v in (0, 1):
            z = _logit(views[v], past["weights"][v])
            low, high = past["limits"][v]
            for own, y in (((by < 0) & (z <= low), 0.0), ((by < 0) & (z >= high), 1.0)):
                by[own], mark[own] = v, y
    return by, mark


def _newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the log-likelihood at w."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (y - p), (x * (p * (1 - p))[:, None]).T @ x


def _limits(counts: np.ndarray, prior: float, pool: int, share: float) -> tuple[float, float]:
    """The log-odds at which a view's most confident rows begin, from its open rows' histogram: about `share` of the
    pool, of each class as much as the prior says, none nearer to the prior's log-odds than SURE."""
    edges = np.linspace(-LIMIT, LIMIT, BINS + 1)
    want = max(1.0, pool * share)
    low = edges[min(BINS, int(np.searchsorted(np.cumsum(counts), want * (1 - prior))) + 1)]
    high = edges[max(0, BINS - 1 - int(np.searchsorted(np.cumsum(counts[::-1]), want * prior)))]
    base = float(np.log(prior / (1 - prior)))
    return min(low, base - SURE), max(high, base + SURE)


def co_train(views: list[np.ndarray], labels: np.ndarray, summed: Callable[[Callable[[list[np.ndarray]], list[np.ndarray]]], list[np.ndarray]], rounds: int = ROUNDS, share: float = SHARE, steps: int = STEPS) -> dict:
    """Co-training over rounds. `summed` applies a function to the views of all unlabelled rows, part by part, and
    adds up its arrays.

    In each round both views score all open unlabelled rows; each hands its most confident rows of both classes to the
    other view as labels, and both are fitted again (Newton steps whose sums run over all pseudo-labelled rows; their
    weight is at most that of the labelled rows). A quarter of the labelled rows takes no part: on it each view is
    calibrated at the end, and the calibrated log-odds are added, the prior counted once.
    """
    aside = np.arange(len(labels)) % 4 == 3
    fitted = [v[~aside] for v in views]
    y = labels[~aside]
    prior = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    weights = [_fit(x, y) for x in fitted]
    history: list[dict] = []
    for _ in range(rounds):
        now, past = [w.copy() for w in weights], list(history)

        def histogram(v: list[np.ndarray], now: list = now, past: list = past) -> list[np.ndarray]:
            still = assigned(v, past)[0] < 0
            z = [np.clip(_logit(x[still], w), -LIMIT, LIMIT) for x, w in zip(v, now, strict=True)]
            return [np.array([len(still)]), *(np.histogram(x, BINS, (-LIMIT, LIMIT))[0] for x in z)]

        pool, *counts = summed(histogram)
        if not pool[0]:
            break
        history.append({"weights": now, "limits": [_limits(c, prior, int(pool[0]), share) for c in counts]})
        for _ in range(steps):
            at, known = [w.copy() for w in weights], list(history)

            def sums(v: list[np.ndarray], at: list = at, known: list = known) -> list[np.ndarray]:
                by, mark = assigned(v, known)
                out = []
                for k in (0, 1):
                    own = by == 1 - k
                    out += [*_newton(v[k][own], mark[own], at[k]), np.array([own.sum()])]
                return out

            total = summed(sums)
            for k in (0, 1):
                gradient, hessian, n = total[3 * k : 3 * k + 3]
                scale = min(1.0, len(y) / max(1, n[0]))
                g, h = _newton(fitted[k], y, weights[k])
                ridge = np.append(np.full(len(weights[k]) - 1, 1.0), 1e-3)
                weights[k] = weights[k] + np.linalg.solve(h + scale * hessian + np.diag(ridge), g + scale * gradient - ridge * weights[k])
    model: dict = {"prior": float(np.log(prior / (1 - prior))), "weights": [w.tolist() for w in weights], "scale": []}
    for v in (0, 1):
        z = np.clip(_logit(views[v][aside], weights[v]), -30, 30)
        scale = _fit(z[:, None], labels[aside], 1e-2) if 0 < labels[aside].mean() < 1 else np.array([1.0, 0.0])
        model["scale"].append([max(0.0, float(scale[0])), float(scale[1])])
    return model


def _matrix(content: np.ndarray, meta: np.ndarray, center: np.ndarray, spread: np.ndarray) -> list[np.ndarray]:
    hot = np.zeros((len(meta), LANGS + SOURCES + SIZES))
    hot[np.arange(len(meta))[:, None], meta] = 1
    return [np.clip((content - center) / spread, -10, 10), hot]


N_CONTENT = len(content_features(""))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Content and metadata of a batch of feature rows."""
    content = np.frombuffer(b"".join(batch.column("content").to_pylist()), "<f4").reshape(-1, N_CONTENT).astype(np.float64)
    return content, np.stack([batch.column(c).to_numpy() for c in ("lang", "source", "size")], axis=1).astype(np.int64)


def _summed(rows: DataFrame, part: Callable[[pa.RecordBatch], list[np.ndarray]]) -> list[np.ndarray]:
    """The arrays that `part` gives for each batch of rows, added up: in each task, then in eight, then here."""

    def packed(arrays: list[np.ndarray]) -> pa.RecordBatch:
        shapes = json.dumps([x.shape for x in arrays])
        return pa.RecordBatch.from_arrays([pa.array([shapes]), pa.array([np.concatenate([x.ravel() for x in arrays]).astype("<f8").tobytes()], pa.binary())], ["shapes", "data"])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = part(batch)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield packed(total)

    def unpack(shapes: str, data: bytes) -> list[np.ndarray]:
        flat, at, out = np.frombuffer(data, "<f8"), 0, []
        for shape in json.loads(shapes):
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for shapes, data in zip(batch.column("shapes").to_pylist(), batch.column("data").to_pylist(), strict=True):
                own = unpack(shapes, data)
                total = own if total is None else [a + b for a, b in zip(total, own, strict=True)]
        if total is not None:
            yield packed(total)

    schema = "shapes string, data binary"
    found = [unpack(r["shapes"], bytes(r["data"])) for r in rows.mapInArrow(first, schema).repartition(8).mapInArrow(again, schema).collect()]
    return [np.sum(x, axis=0) for x in zip(*found, strict=True)]


def quality_classifier(docs: DataFrame, labels: DataFrame, most_per_class: int = MOST_PER_CLASS) -> DataFrame:
    """Scores the quality of every document: doc_id, held_out, content_score, metadata_score, score, predicted.

    Features of all documents are computed once and written (some 90 bytes a document). Labels come from a bounded
    sample, chosen by hashed id, of rows that are not held out (crc32 of the id modulo 4 is not 2); the pool of
    pseudo-labels is every other row that is not held out. Each pass of the rounds runs over the whole pool in the
    cluster; only sums of fixed size (histograms, gradients, Hessians) come to the driver.

    Defined cases: null text is empty; null metadata are values of their own, as is a missing lang, source or n_chars
    column; without labels of both classes every score is the labels' share (0.5 without any); several labels of an
    id count as their highest, of rows that repeat a labelled id one is learnt from; repeated rows give a row each;
    texts of any length count whole; an empty table gives no rows. Other columns are ignored.
    """
    importable(docs.sparkSession)
    column = lambda c, kind: (F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(c)
    frame = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), column("lang", "string"), column("source", "string"), column("n_chars", "long"))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("mark"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("mark = 1").orderBy(*by_hash).limit(most_per_class).unionByName(known.where("mark = 0").orderBy(*by_hash).limit(most_per_class))
    marked = frame.join(F.broadcast(chosen), "doc_id", "left").withColumn("mark", F.when(held_out(), -2).otherwise(F.coalesce("mark", F.lit(-1))))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            content = [np.array(content_features(t), "<f4").tobytes() for t in batch.column("text").to_pylist()]
            meta = zip(*[metadata_places(*x) for x in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(content, pa.binary()), *(pa.array(x, pa.int32()) for x in meta)], ["doc_id", "mark", "content", "lang", "source", "size"])

    id_type = frame.schema["doc_id"].dataType.simpleString()
    rows = staged(marked.select("doc_id", "mark", "text", "lang", "source", "n_chars").mapInArrow(features, f"doc_id {id_type}, mark int, content binary, lang int, source int, size int"), "quality-features")
    sample = rows.where("mark >= 0").groupBy("doc_id").agg(F.min(F.struct("mark", "content", "lang", "source", "size")).alias("r")).select("r.*", F.xxhash64("doc_id").alias("h"), "doc_id").toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending")])
    mark = sample["mark"].to_numpy()
    model: dict = {"flat": float(mark.mean()) if len(mark) else 0.5}
    if len(set(mark.tolist())) == 2 and len(mark) >= 8:

        def moments(batch: pa.RecordBatch) -> list[np.ndarray]:
            content = _unpacked(batch)[0]
            return [np.array([len(content)]), content.sum(axis=0), (content**2).sum(axis=0)]

        n, total, squares = _summed(rows.select("content", "lang", "source", "size"), moments)
        center = total / n[0]
        spread = np.sqrt(np.maximum(squares / n[0] - center**2, 0)) + 1e-6
        views = _matrix(*_unpacked(sample.combine_chunks().to_batches()[0]), center, spread)
        pool = rows.where("mark = -1").select("content", "lang", "source", "size")
        model = co_train(views, mark.astype(float), lambda f: _summed(pool, lambda b: f(_matrix(*_unpacked(b), center, spread))) or [np.zeros(1)])
        model |= {"center": center, "spread": spread}

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if "flat" in model:
                out = [np.full(n, model["flat"])] * 3
            else:
                views = _matrix(*_unpacked(batch), model["center"], model["spread"])
                z = [np.clip(_logit(x, np.array(w)), -30, 30) * s[0] + s[1] for x, w, s in zip(views, model["weights"], model["scale"], strict=True)]
                out = [1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in (*z, z[0] + z[1] - model["prior"])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], ["doc_id", "content_score", "metadata_score", "score"])

    scored = rows.mapInArrow(score, f"doc_id {id_type}, content_score double, metadata_score double, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "content_score", "metadata_score", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
