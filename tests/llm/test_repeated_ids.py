"""Training of the quality classifier where one id has many rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from inspectra.llm import quality


def test_one_row_of_an_id_trains_whatever_the_order(spark, monkeypatch):
    rows = [(k, f"word{k % 7} the of {'good' if k % 3 else 'BAD!!'}", "en", "s", 20.0) for k in range(80)]
    rows += [(5, f"other text {k}", "en", "s", 12.0) for k in range(300)]
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(60)], "doc_id long, quality long")
    seen, models, fit = [], [], quality.co_train
    monkeypatch.setattr(quality, "co_train", lambda labelled, y, pool: seen.append((labelled, y)) or fit(labelled, y, pool))
    reached = []
    collect = type(spark.range(0)).toPandas
    monkeypatch.setattr(type(spark.range(0)), "toPandas", lambda df: reached.append(got := collect(df)) or got)
    for order in (F.col("text"), F.desc("text")):
        docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double").orderBy(order).coalesce(2)
        models.append(quality.fit(docs, labels))
    assert [len(r) for r in reached] == [60, 60]
    (a, y), (b, z) = seen
    assert len(y) == 60 and (y == z).all()
    assert all(np.array_equal(i, j) for i, j in zip(a, b, strict=True))
    assert models[0].handed == models[1].handed and np.allclose(models[0].both.weights, models[1].both.weights)


def test_the_pool_is_the_whole_table(spark):
    """A round over a table hands over what a plain search of all rows finds:
    the surest rows of each view, equal ones once, no labelled or earlier ones."""
    rng = np.random.default_rng(5)
    text = lambda good: " ".join(rng.choice(["the", "of", "thing", "ention"], 30)) if good else "!! ".join(rng.choice(["BUY", "WIN", "NOW"], 30))
    rows = [(k, text(k % 3), "en" if k % 3 else "xx", f"s{k % 3}", 40.0 + k % 7) for k in range(900)]
    rows += [(None, *rows[300][1:]), *([(10_000 + k, *rows[301][1:]) for k in range(400)]), (700, None, None, None, None), *rows[310:320]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars double").repartition(5)
    labels = [k for k in range(200)]
    frame = quality.with_marks(docs, "doc_id").toPandas()
    own = frame[frame["_id"].isin(labels)]
    views, y = [], np.array([float(k % 3 > 0) for k in own["_id"]])
    for x in (v.astype(np.float64) for v in quality.features_of(own)):
        model = quality.Regression.fit(x, y)
        views.append(quality.View(model, quality.Regression.fit(model.odds(x)[:, None], y)))
    pool = quality.TablePool(quality.with_marks(docs, "doc_id"), labels)
    rest = frame[~frame["_id"].isin(labels)].drop(columns="_id").drop_duplicates()
    for _ in range(3):
        now = rest[~np.isin(rest["mark"], [mark for mark, _ in pool.taken])]
        features = [v.astype(np.float64) for v in quality.features_of(now)]
        got = pool.offer(views, 60, 0.9)
        for k, view in enumerate(views):
            odds = np.round(view.odds(features[k]), 6)
            for good, side in ((1.0, odds), (0.0, -odds)):
                sure = np.sort(side[side >= np.log(9)])[::-1][:60]
                (mine, label) = got[k]
                have = np.round(view.odds(mine[k][label == good]), 6) * (1 if good else -1)
                assert np.allclose(np.sort(have)[::-1], sure, atol=2e-6)
        assert sum(len(label) for _, label in got) > 100
    assert len(pool.taken) == len(set(pool.taken)) > 300
