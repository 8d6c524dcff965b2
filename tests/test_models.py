"""Similarity clusters and models per group against brute force."""

import math

import numpy as np
import pytest

from revaxis.operators import grouped, similarity

BY = ["app_id"]


def brute_clusters(rows, threshold):
    """The smallest id of each component of points closer than the threshold."""
    names = {i: i for i, v in rows}
    moved = True
    while moved:
        moved = False
        for i, v in rows:
            for j, w in rows:
                if len(v) == len(w) and (math.dist(v, w) < threshold or v == w) and names[i] != names[j]:
                    names[i] = names[j] = min(names[i], names[j])
                    moved = True
    return names


@pytest.mark.parametrize("threshold, block", [(0.25, 2_048), (0.25, 3), (2.0, 5), (100.0, 4), (1e-6, 9), (0.0, 9)])
def test_linked_clusters_against_all_pairs(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(similarity, "BLOCK", block)
    draw = np.random.default_rng(3)
    points = [[float(x) for x in p] for p in draw.normal(size=(8, 4))[draw.integers(0, 8, 70)] + 0.1 * draw.normal(size=(70, 4))]
    points += points[:6] + [[0.5], [0.6], [9.0], [-1.0, 1.0]]
    rows = [(100 - i, p, "x") for i, p in enumerate(points)]
    odd = [(500, None, "x"), (None, points[0], "x"), (501, [None] * 4, "x")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, cluster_id string").repartition(3)
    got = {r["vec_id"]: r["cluster_id"] for r in similarity.linked_clusters(df, threshold).collect()}
    assert got == brute_clusters([(i, v) for i, v, _ in rows], threshold) | {500: None, None: None, 501: None}
    assert similarity.linked_clusters(df.limit(0), threshold).count() == 0


def test_labels_travel_along_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 90), (7, 7)], "x long, y long")
    found = dict(map(tuple, similarity.connected(links).collect()))
    assert found == {i: 0 for i in range(61)} | {100: 90, 90: 90}


def texts_of(spark, rows):
    return spark.createDataFrame([(str(i), app, text) for i, (app, text) in enumerate(rows)], "review_id string, app_id string, review string")


def made(seed):
    draw = np.random.default_rng(seed)
    words = {"a": ["login", "password", "account", "crash", "screen", "freeze"], "b": ["price", "refund", "money", "ads", "banner", "spam"]}
    rows = []
    for i in range(60):
        app = "ab"[i % 3 == 0]
        half = words[app][:3] if i % 2 else words[app][3:]
        rows.append((app, " ".join(draw.choice(half, 6)) + " " + str(draw.choice(words[app]))))
    return rows + [("c", "one two three four five"), ("c", "six seven eight nine ten"), (None, "one two three four five")]


def test_group_features_against_plain_counts(spark):
    rows = made(1)
    features, known = grouped.group_features(texts_of(spark, rows), BY, vocabulary=5, min_df=2, max_df=0.9)
    for group in known.where("app_id is not null").collect():
        texts = [t.split() for app, t in rows if app == group["app_id"]]
        tf, df = {}, {}
        for t in texts:
            for w in t:
                tf[w] = tf.get(w, 0) + 1
            for w in set(t):
                df[w] = df.get(w, 0) + 1
        names = sorted((w for w in tf if 2 <= df[w] <= 0.9 * len(texts)), key=lambda w: (-tf[w], w))[:5]
        assert (group["n"], group["vocabulary"]) == (len(texts), names)
        for r in features.where(f"app_id = '{group['app_id']}'").collect():
            words = r["review"].split()
            raw = [words.count(w) * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w in names]
            size = math.sqrt(sum(w * w for w in raw)) or 1
            assert {t["i"]: t["w"] for t in r["terms"]} == pytest.approx({i: w / size for i, w in enumerate(raw) if w})


def test_grouped_kmeans_against_rounds_by_hand(spark):
    import hashlib

    from pyspark.sql import functions as F

    rows = made(2)
    features, known = grouped.group_features(texts_of(spark, rows), BY, vocabulary=8)
    features = features.where("app_id is not null").join(known.select("app_id", "n"), "app_id")
    got, centres = grouped.grouped_kmeans(features, BY, F.when(F.col("app_id") == "a", 3).otherwise(2), 8)
    got = {r["review_id"]: r["centre"] for r in got.collect()}
    assert len(got) == 62
    for app, k in (("a", 3), ("b", 2), ("c", 2)):
        own = sorted((r["review_id"], r["terms"]) for r in features.where(F.col("app_id") == app).collect())
        own.sort(key=lambda r: hashlib.md5(r[0].encode()).hexdigest())
        x = np.zeros((len(own), 8))
        for i, (_, terms) in enumerate(own):
            for t in terms:
                x[i, t["i"]] = t["w"]
        middle = x[:k].copy()
        for _ in range(grouped.ROUNDS + 1):
            label = np.argmin(np.round((middle**2).sum(1) - 2 * x @ middle.T, 9), axis=1)
            last = middle.copy()
            for c in range(k):
                if (label == c).any():
                    middle[c] = x[label == c].mean(0)
        label = np.argmin(np.round((last**2).sum(1) - 2 * x @ last.T, 9), axis=1)
        assert {i: got[i] for i, _ in own} == {i: int(c) for (i, _), c in zip(own, label)}


def test_group_topics_and_themes(spark):
    texts = texts_of(spark, made(3))
    summary, assigned = grouped.group_topics(texts, n_topics=2)
    rows = summary.collect()
    assert {r["app_id"] for r in rows} == {"a", "b"}  # two texts are too few for topics
    for app in "ab":
        own = [r for r in rows if r["app_id"] == app]
        assert sum(r["size"] for r in own) == own[0]["total_texts"] == assigned.where(f"app_id = '{app}'").count()
        assert all(len(r["keywords"]) >= 3 for r in own)
    themes = grouped.group_key_themes(summary, k=1).collect()
    assert [t["rank"] for t in themes] == [1, 1] and all(t["theme_name"].startswith("Theme 1: ") and t["percentage"] >= 50 for t in themes)
    assert grouped.group_topics(texts.limit(0))[0].count() == 0
    assert grouped.group_text_clusters(texts, BY, 20, 2, 10, 5, 100).where("app_id = 'c'").count() == 0
    assert grouped.group_text_clusters(texts, BY, 20, 2, 10, 5, 100).select("app_id", "cluster_id").distinct().count() == 4


@pytest.mark.parametrize("how, finish", [
    ({"k": 4}, 20), ({"k": 35}, 1), ({"threshold": 1.0}, 1), ({"threshold": 2.0}, 30)])
def test_ward_linkage_equals_brute_force(spark, how, finish):
    """In rounds only, and with the last clusters merged on the driver."""
    from revaxis.operators.linkage import ward_linkage
    from test_operators import brute_ward

    points = np.random.default_rng(7).normal(size=(50, 3))
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, v array<double>")
    expected = brute_ward(points, **how)
    groups = {}
    for row in ward_linkage(df, "v", id_column="id", finish=finish, **how).collect():
        groups.setdefault(row["cluster_id"], set()).add(row["id"])
    assert {frozenset(g) for g in groups.values()} == expected
    assert all(name == min(group) for name, group in groups.items())


def test_ward_linkage_has_no_limit_of_clusters_and_handles_odd_rows(spark):
    from revaxis.operators.linkage import ward_linkage

    rng = np.random.default_rng(5)
    spots = rng.permutation(700)
    rows = [(i, [float(spot % 30) * 10, float(spot // 30) * 10]) for i, spot in enumerate(spots)]
    rows += [(1000 + i, v) for i, v in rows]
    odd = [(3000, None), (3001, [1.0, None]), (3002, [float("nan"), 0.0]), (3003, []), (3004, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    found = {r["id"]: r["cluster_id"] for r in ward_linkage(df, "v", threshold=1.0, id_column="id").collect()}
    assert all(found[i] == i % 1000 for i, _ in rows) and all(found[i] is None for i, _ in odd)
    # All merges cost the same at first: any choice will do, and the number is kept.
    assert ward_linkage(df, "v", k=650, finish=4).where("cluster_id is not null").select("cluster_id").distinct().count() == 650
    assert ward_linkage(df.limit(0), "v", k=2).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        ward_linkage(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v", k=1)


def test_phrase_clusters_take_negative_and_neutral_reviews_with_phrases(spark):
    from revaxis.operators.linkage import phrase_clusters

    groups = ("battery drain heat", "refund charge billing", "login password account")
    rows = [(f"{i}-{n}", "a", "negative" if n % 2 else "Neutral", text) for i, text in enumerate(groups) for n in range(5)]
    rows += [("p", "a", "positive", groups[0]), ("e", "a", "negative", ""), ("n", "a", None, groups[0]), ("s", "a", "neutral", "the of")]
    df = spark.createDataFrame(rows, "review_id string, app_id string, sentiment string, review string")
    found = {}
    for row in phrase_clusters(df).collect():
        found.setdefault(row["cluster_id"], set()).add(row["review_id"])
    # 15 reviews make three clusters.
    assert {frozenset(g) for g in found.values()} == {frozenset(f"{i}-{n}" for n in range(5)) for i in range(3)}
    assert phrase_clusters(df.limit(0)).count() == 0


def test_methods_share_text_features(spark, make_reviews, monkeypatch):
    from revaxis.operators import clusters

    words = ("slow", "crash", "login", "refund", "ads", "battery")
    # One file, since seeds of k-means go by the order of rows.
    rows = make_reviews(*((i, "a", 1, f"{words[i % 6]} {words[i // 6 % 6]} app") for i in range(60))).coalesce(1)
    settings, methods = (5, 2, 10, 2, 100), ("ward", "bisecting", "kmeans")
    alone = [clusters.complaint_text_clusters(rows, *settings, method=m) for m in methods]
    features = clusters.complaint_text_features(rows, 2, 100)
    monkeypatch.setattr(clusters, "tfidf_features", None)  # the texts are not read again
    shared = [clusters.complaint_text_clusters(rows, *settings, method=m, features=features) for m in methods]
    for one, other in zip(alone, shared, strict=True):
        assert one.columns == other.columns
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, other.collect()))
    assert clusters.complaint_text_features(rows.limit(1), 2, 100) is None
    assert clusters.complaint_text_clusters(rows.limit(1), *settings).count() == 0


def test_centres_meet_blocks_of_texts(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(grouped, "BLOCK", 5)
    texts = texts_of(spark, made(4) + made(4)[:9] + [("a", "the and")])
    features, _ = grouped.group_features(texts, BY, vocabulary=6)
    features = grouped.materialized(features)
    seeds = grouped.seed_centres(features, BY, F.lit(3), "review_id", 6)
    blocks = grouped.packed(features.where("app_id is not null"), BY).select("app_id", F.size("texts").alias("n"), F.explode("texts.row").alias("row")).collect()
    of = {r["row"]: r["app_id"] for r in features.where("app_id is not null").collect()}
    assert {r["row"]: r["app_id"] for r in blocks} == of and len(blocks) == len(of)
    # Centres are copied once for a block: blocks are many fewer than texts, and none holds a whole group.
    assert sum(1 / r["n"] for r in blocks) < len(of) / 2 and max(r["n"] for r in blocks if r["app_id"] == "a") < 20
    middle = {}
    for r in seeds.collect():
        middle.setdefault(r["app_id"], []).append((r["centre"], r["dense"]))
    for df in (features, features.drop("row")):
        near = grouped.nearest_centres(df, seeds, BY)
        assert near.columns == [*BY, *(c for c in df.columns if c not in BY), "centre"]
        for r in near.collect():
            far = [(round(sum(x * x for x in c) - 2 * sum(t["w"] * c[t["i"]] for t in r["terms"]), 9), at) for at, c in middle[r["app_id"]]]
            assert r["centre"] == min(far)[1]


def test_whole_units_as_spark_rounds(spark):
    from pyspark.sql import functions as F

    x = np.array([0.1234567890125, -0.1234567890125, 1 / 3, 0.5, 0.0, 1.0000000005, -1.0000000005, 0.0000000000005, 2.5e-12])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for digits in (9, 12):
        want = [int(r[0].scaleb(digits)) for r in df.select(F.col("x").cast(f"decimal(24,{digits})")).collect()]
        assert grouped._whole(x, digits).astype(int).tolist() == want
