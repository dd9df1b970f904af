"""Quality classifier by co-training on two views of a document.

The text view has shares of character classes and of their bigrams, and how
varied words and lines are. The metadata view has language, source and length.
Each view has a logistic regression. In every round either classifier labels
the pool's rows that it is most sure of, and they join the other's training
rows. A view hands over a label only where its calibrated probability reaches
``SURE``, so that a view which can't tell says nothing. In the end both are
calibrated on labelled rows held out of training, a last regression on the two
calibrated log-odds weighs them, and all documents are scored where they are
read.

Labelled rows are a bounded sample: at most ``LABELLED``, those with the least
hash of their id. The pool is every other row of the table: in each round all
are judged where they are read, each task keeps the ``HANDED`` it is surest of
by view and kind, and these lists are merged, first by task number, then whole.
Rows of equal content count once, so that a text that is in a third of all rows
is handed over as one. Rounds end early where neither view has anything to say.

Defined cases: null text, language or source counts as empty, a null length as
zero; labels that are null or have no document are passed over, labels that
repeat count by their mean; with labels of one kind only every document gets
that kind's score, without labels the score 1; a null id is in the pool and is
scored as any other; rows as sure as each other go by a hash of their content; repeated rows each get a row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELLED = 8_000
ROUNDS = 3
HANDED = 400
SURE = 0.97
KEEP = 0.5
META_BUCKETS = 64

_GROUPS = [
    *([chr(c)] for c in b" \n!|*#$%&"),
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0123456789",
    ".,;:?'\"()-",
    [chr(c) for c in range(128) if not chr(c).isprintable() and chr(c) != "\n"],
]
OTHER, WIDE = len(_GROUPS), len(_GROUPS) + 1
CLASSES = WIDE + 1


def _class_table() -> np.ndarray:
    out = np.full(256, OTHER, dtype=np.int64)
    out[128:] = WIDE
    for k, group in enumerate(_GROUPS):
        for c in group:
            out[ord(c)] = k
    return out


_CLASS = _class_table()
TEXT_SIZE = CLASSES + CLASSES**2 + 6


def text_features(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
    out = np.zeros(TEXT_SIZE, dtype=np.float32)
    if not len(raw):
        return out
    kinds = _CLASS[raw]
    out[:CLASSES] = np.bincount(kinds, minlength=CLASSES) / len(raw)
    if len(raw) > 1:
        out[CLASSES : CLASSES + CLASSES**2] = np.bincount(kinds[:-1] * CLASSES + kinds[1:], minlength=CLASSES**2) / (len(raw) - 1)
    words, lines = text.split(), text.split("\n")
    if words:
        again = sum(a == b for a, b in zip(words, words[1:], strict=False))
        out[-6:] = (
            np.log1p(len(words)), sum(map(len, words)) / len(words) / 10, len(set(words)) / len(words),
            len(set(words)) / len(words) ** 0.8, again / len(words), len(set(lines)) / len(lines),
        )
    return out


def meta_features(lang: str | None, source: str | None, n_chars: float | None) -> np.ndarray:
    out = np.zeros(META_BUCKETS + 3, dtype=np.float32)
    for mark, value in (("lang", lang), ("source", source)):
        out[zlib.crc32(f"{mark}={value or ''}".encode()) % META_BUCKETS] += 1
    size = np.log1p(max(0.0, n_chars or 0.0))
    out[META_BUCKETS:] = size, size**2 / 10, size < 4
    return out


@dataclass
class Regression:
    """Logistic regression with a ridge, by Newton's method on scaled features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 12) -> Regression:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        z = np.hstack([np.ones((len(x), 1)), ((x - mean) / scale).clip(-8, 8)])
        w, keep = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        keep[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-(z @ w).clip(-30, 30)))
            hessian = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(keep)
            w = w + np.linalg.solve(hessian, z.T @ (y - p) - keep * w)
        return cls(mean, scale, w)

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Logarithms of the odds of good quality."""
        return (((x - self.mean) / self.scale).clip(-8, 8) @ self.weights[1:] + self.weights[0]).clip(-30, 30)


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-z))


@dataclass
class View:
    model: Regression
    calibration: Regression

    def odds(self, x: np.ndarray) -> np.ndarray:
        return self.calibration.odds(self.model.odds(x)[:, None])


@dataclass
class CoTrained:
    """The two views and their combination; without views, a fixed score."""

    text: View | None
    meta: View | None
    both: Regression | None
    fixed: float
    handed: tuple[int, ...] = ()

    def score(self, text: np.ndarray, meta: np.ndarray) -> np.ndarray:
        if self.both is None:
            return np.full(len(text), self.fixed)
        return logistic(self.both.odds(np.column_stack([self.text.odds(text), self.meta.odds(meta)])))


#: Of a row that a view is sure of: 0 (text) or 1 (metadata), good or bad, how
#: far the view's odds are on that side, and a hash of the row's content.
SURE_ROWS = "view int, good boolean, odds double, mark long, tie long"


def sure_rows(views: list[View], features: tuple[np.ndarray, np.ndarray], marks: np.ndarray, ties: np.ndarray, sure: float) -> pd.DataFrame:
    """As SURE_ROWS, with "at": the row's place in the features."""
    limit, out = np.log(sure / (1 - sure)), []
    for k, (view, x) in enumerate(zip(views, features, strict=True)):
        odds = np.round(view.odds(x), 6) if len(x) else np.zeros(0)
        for good, side in ((True, odds), (False, -odds)):
            at = np.flatnonzero(side >= limit)
            out.append(pd.DataFrame({"view": np.int32(k), "good": good, "odds": side[at], "mark": marks[at], "tie": ties[at], "at": at}))
    return pd.concat(out)


def surest(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """Of each view and kind the rows that the view is surest of; equal ones once."""
    rows = rows.sort_values(["view", "good", "odds", "mark", "tie"], ascending=[True, True, False, True, True], kind="stable")
    return rows.drop_duplicates(["view", "good", "mark", "tie"]).groupby(["view", "good"]).head(most)


#: What the views hand over, by view: the features of both views, and 1 for good.
Offer = list[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]


class ArrayPool:
    """A pool whose features are at hand."""

    def __init__(self, text: np.ndarray, meta: np.ndarray) -> None:
        self.features, self.free = (text, meta), np.ones(len(text), dtype=bool)

    def offer(self, views: list[View], handed: int, sure: float) -> Offer:
        free = np.flatnonzero(self.free)
        got = surest(sure_rows(views, tuple(x[free] for x in self.features), free, np.zeros(len(free), np.int64), sure), handed)
        self.free[got["mark"].to_numpy(np.int64)] = False
        out = []
        for k in range(2):
            own = got[got["view"] == k]
            at = own["mark"].to_numpy(np.int64)
            out.append((tuple(x[at] for x in self.features), own["good"].to_numpy(np.float64)))
        return out


def co_train(labelled: tuple[np.ndarray, np.ndarray], y: np.ndarray, pool: tuple[np.ndarray, np.ndarray] | ArrayPool | TablePool, rounds: int = ROUNDS, handed: int = HANDED, sure: float = SURE) -> CoTrained:
    """labelled: the features of both views; pool: these of unlabelled rows, or
    what offers such rows. Every fourth labelled row is held out for calibration."""
    kept = np.arange(len(y)) % 4 == 3
    if len(np.unique(y[~kept])) < 2 or len(np.unique(y[kept])) < 2:
        return CoTrained(None, None, None, float(y.mean()) if len(y) else 1.0)
    pool = ArrayPool(*pool) if isinstance(pool, tuple) else pool
    own, counts, views = [(x[~kept], y[~kept]) for x in labelled], [], []
    for turn in range(rounds + 1):
        views = []
        for x, (train_x, train_y) in zip(labelled, own, strict=True):
            model = Regression.fit(train_x, train_y)
            views.append(View(model, Regression.fit(model.odds(x[kept])[:, None], y[kept], ridge=0.1)))
        if turn == rounds:
            break
        offered = pool.offer(views, handed, sure)
        counts += [len(new_y) for _, new_y in offered]
        if not any(counts[-2:]):
            break
        for k, (features, new_y) in enumerate(offered):
            x, old_y = own[1 - k]
            own[1 - k] = np.vstack([x, features[1 - k]]), np.concatenate([old_y, new_y])
    odds = np.column_stack([v.odds(x[kept]) for v, x in zip(views, labelled, strict=True)])
    return CoTrained(views[0], views[1], Regression.fit(odds, y[kept], ridge=0.1), float(y.mean()), tuple(counts))


def columns_of(df: DataFrame) -> list[Column]:
    """What the features are made of; a column that is missing counts as null."""
    kinds = {"text": "string", "lang": "string", "source": "string", "n_chars": "double"}
    return [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in kinds.items()]


def features_of(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    text = np.array([text_features(t) for t in rows["text"]], dtype=np.float32).reshape(len(rows), TEXT_SIZE)
    meta = np.array([meta_features(a, b, None if pd.isna(n) else n) for a, b, n in zip(rows["lang"], rows["source"], rows["n_chars"], strict=True)], dtype=np.float32)
    return text, meta.reshape(len(rows), META_BUCKETS + 3)


CONTENT = ["text", "lang", "source", "n_chars"]
FEATURES = "text binary, meta binary"


def with_marks(docs: DataFrame, id_col: str) -> DataFrame:
    """_id, what features are made of, and two hashes of it."""
    rows = docs.withColumn("_id", F.col(id_col).cast("long")).select("_id", *columns_of(docs))
    return rows.withColumns({"mark": F.xxhash64(*CONTENT), "tie": F.xxhash64(F.lit("tie"), *CONTENT)})


def packed(rows: pd.DataFrame) -> dict[str, list[bytes]]:
    return {name: [x.tobytes() for x in part] for name, part in zip(("text", "meta"), features_of(rows), strict=True)}


def unpacked(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    sizes = {"text": TEXT_SIZE, "meta": META_BUCKETS + 3}
    return tuple(np.frombuffer(b"".join(rows[c]), dtype=np.float32).reshape(len(rows), size).astype(np.float64) for c, size in sizes.items())


class TablePool:
    """All rows of a table as a pool. An offer reads the table once to judge every
    row, and once for the features of the few rows chosen; ``most`` of these by
    view and kind reach the driver."""

    def __init__(self, rows: DataFrame, labelled: list[int]) -> None:
        """rows: as with_marks."""
        self.spark = rows.sparkSession
        self.rows = rows.join(F.broadcast(self.spark.createDataFrame([(i,) for i in labelled], "_id long")), "_id", "left_anti")
        self.taken: list[tuple[int, int]] = []

    def offer(self, views: list[View], handed: int, sure: float) -> Offer:
        sent = self.spark.sparkContext.broadcast((views, handed, sure))

        def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            (views, most, sure), held = sent.value, []
            for batch in batches:
                held.append(sure_rows(views, features_of(batch), batch["mark"].to_numpy(), batch["tie"].to_numpy(), sure))
                held = [surest(pd.concat(held), most)]
            for rows in held:
                yield rows.drop(columns="at").assign(turn=np.int32(TaskContext.get().partitionId() % 64))

        def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: list[pd.DataFrame] = []
            for batch in batches:
                held = [surest(pd.concat([*held, batch]), sent.value[1])]
            yield from held

        marks = "mark long, tie long"
        free = self.rows.join(F.broadcast(self.spark.createDataFrame(self.taken, marks)), ["mark", "tie"], "left_anti")
        lists, key = SURE_ROWS + ", turn int", ["view", "good"]
        found = free.mapInPandas(judge, lists).repartition(*key, "turn").mapInPandas(merge, lists).repartition(*key).mapInPandas(merge, lists)
        got = pd.DataFrame(found.drop("turn").collect(), columns=[*key, "odds", "mark", "tie"])
        chosen = list(dict.fromkeys(zip(got["mark"].tolist(), got["tie"].tolist(), strict=True)))

        def featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: set[tuple[int, int]] = set()  # no more than are chosen
            for batch in batches:
                new = [at for at, key in enumerate(zip(batch["mark"].tolist(), batch["tie"].tolist(), strict=True)) if not (key in seen or seen.add(key))]
                part = batch.iloc[new]
                yield part[["mark", "tie"]].assign(**packed(part))

        features = free.join(F.broadcast(self.spark.createDataFrame(chosen, marks)), ["mark", "tie"]).mapInPandas(featured, f"{marks}, {FEATURES}")
        one = features.groupBy("mark", "tie").agg(F.first(F.struct("text", "meta")).alias("row")).select("mark", "tie", "row.*")
        got = surest(got.merge(pd.DataFrame(one.collect() if chosen else [], columns=["mark", "tie", "text", "meta"]), on=["mark", "tie"]), handed)
        self.taken += chosen
        parts = [got[got["view"] == k] for k in range(2)]
        return [(unpacked(part), part["good"].to_numpy(np.float64)) for part in parts]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", labelled: int = LABELLED) -> CoTrained:
    """The labelled ids are chosen first; only their documents' texts become
    features, in tasks, and only features reach the driver. Where an id has
    several rows, one of them trains, the same in whatever order they come."""
    ids = docs.select(F.col(id_col).cast("long").alias("_id")).where("_id IS NOT NULL").distinct()
    known = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("double").alias("y")).where("_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("_id").agg((F.avg("y") >= 0.5).cast("double").alias("y"))
    chosen = known.join(ids, "_id", "left_semi").orderBy(F.xxhash64("_id", F.lit("sample")), "_id").limit(labelled)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[["_id", "y", "mark", "tie"]].assign(**packed(batch))

    all_ = with_marks(docs, id_col)
    rows = all_.join(F.broadcast(chosen), "_id").mapInPandas(run, f"_id long, y double, mark long, tie long, {FEATURES}")
    one = F.min_by(F.struct("y", "text", "meta"), F.struct("mark", "tie"))  # an id's rows, however many, come to one in each task
    got = rows.groupBy("_id").agg(one.alias("row")).select("_id", "row.*").toPandas().sort_values("_id")
    got = got.iloc[np.argsort([zlib.crc32(str(i).encode()) for i in got["_id"]], kind="stable")]
    return co_train(unpacked(got), got["y"].to_numpy(np.float64), TablePool(all_, got["_id"].tolist()))


def score(docs: DataFrame, model: CoTrained, id_col: str = "doc_id", keep: float = KEEP) -> DataFrame:
    """One row per document: doc_id, score (probability of good quality), kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            p = model.score(*features_of(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "score": p, "kept": p >= keep})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *columns_of(docs)).mapInPandas(run, "doc_id long, score double, kept boolean")


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = KEEP, **columns: str) -> DataFrame:
    """The documents that aren't rejected, with all their columns, unshuffled."""
    model = fit(docs, labels, **columns)
    inputs = [c for c in ("text", "lang", "source", "n_chars") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.select(inputs).to_pandas() if batch.num_rows else pd.DataFrame(columns=inputs)
            if "n_chars" in inputs:
                rows["n_chars"] = pd.to_numeric(rows["n_chars"], errors="coerce")
            for c in {"text", "lang", "source", "n_chars"} - set(inputs):
                rows[c] = None
            yield batch.filter(pa.array(model.score(*features_of(rows)) >= keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
