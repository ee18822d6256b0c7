"""Toxicity and quality: held-out accuracy, edge cases, and the parts of the models."""

import random
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veldra.llm import quality_model, queries, toxicity
from veldra.llm.token_table import held_out, labelled_sample

LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "divisor", "rest", "least", "bar"), [("op1_toxicity", "toxic", 3, 1, 0.7, 0.93), ("op2_quality_model", "quality", 5, 0, 0.3, 0.93)])
def test_held_out_accuracy(spark, name, label, divisor, rest, least, bar):
    rows = queries.QUERIES[name](spark, LARGER).toPandas()
    docs = pd.read_parquet(f"{LARGER}/documents.parquet")
    assert sorted(rows.doc_id) == sorted(docs.doc_id) and rows.score.between(0, 1).all()
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % divisor == rest for i in rows.doc_id]).all()
    assert (rows.predicted == (rows.score >= least)).all()
    judged = rows.merge(pd.read_parquet(f"{LARGER}/labels.parquet"), on="doc_id")
    judged = judged[judged.held_out]
    assert (judged.predicted == judged[label]).mean() >= bar


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_sample_is_bounded_and_keeps_the_held_out_apart(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(40)])
    labels = labels_of(spark, [*((i, 1, i % 2) for i in range(40)), (0, 0, 1), (5, None, None), (None, 1, 1), (99, 1, 1)])
    held = held_out(3, 1)
    rows = labelled_sample(docs, labels, "toxic", ~held, 12).collect()
    assert len(rows) in (11, 12) and all(zlib.crc32(str(r.doc_id).encode()) % 3 != 1 for r in rows)
    every = {r.doc_id: r.label for r in labelled_sample(docs, labels, "toxic", ~held, 1000).collect()}
    assert every.get(0, 1) == 1 and set(every) <= set(range(40))


def test_repeated_labelled_ids_stay_within_the_limit(spark, docs_of):
    docs = docs_of([(i % 3, f"text {i}") for i in range(60)])
    labels = labels_of(spark, [(0, 0, 1), (1, 0, 0), (2, 0, 1), (2, 0, 0)])
    rows = labelled_sample(docs, labels, "toxic", F.lit(True), 2).collect()
    assert len(rows) == 2 and sorted(rows) == sorted(labelled_sample(docs.repartition(7), labels, "toxic", F.lit(True), 2).collect())


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_odd_texts_are_scored(spark, docs_of, module):
    rnd = random.Random(4)
    good = ["plain words of a calm text " * rnd.randint(1, 4) for _ in range(60)]
    bad = ["you scum !!! $$$ moron ### TRASH " * rnd.randint(1, 4) for _ in range(60)]
    docs = docs_of([*good, *bad])
    labels = labels_of(spark, [(i, int(i < 60), int(i >= 60)) for i in range(120)])
    sample = labelled_sample(docs, labels, "toxic" if module is toxicity else "quality", F.lit(True), 1000)
    model = module.fit(sample)
    odd = [None, "", "\n", "😀", "a" * 100_000, "you scum moron " * 20_000, "calm words of a text", "plain words of a calm text"]
    rows = {r.doc_id: r.score for r in module.score(docs_of([*odd, odd[-1]]), model).collect()}
    assert len(rows) == len(odd) + 1 and all(0 <= s <= 1 for s in rows.values()) and rows[0] == rows[1] and rows[7] == rows[8]
    assert (rows[5] > rows[7]) if module is toxicity else (rows[5] < rows[7])
    assert module.score(docs.where("false"), model).count() == 0


@pytest.mark.parametrize("module", [toxicity, quality_model])
@pytest.mark.parametrize("given", [[], [(0, 1, 1), (1, 1, 1)]])
def test_labels_of_one_kind_or_none(spark, docs_of, module, given):
    docs = docs_of(["a b", "c d", ""])
    sample = labelled_sample(docs, labels_of(spark, given), "toxic", F.lit(True), 10)
    scores = {r.score for r in module.score(docs, module.fit(sample)).collect()}
    assert len(scores) == 1 and (scores.pop() > 0.5) == bool(given)


def test_trees_learn_an_interaction():
    rnd = np.random.default_rng(0)
    x = rnd.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.fit_trees(x[:1500], y[:1500])
    assert ((trees(x[1500:]) > 0) == y[1500:]).mean() > 0.95


def test_isotonic_map_rises_and_averages_ties():
    own = toxicity.Isotonic(np.array([0.0, 1.0, 1.0, 2.0, 3.0]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]))
    got = own(np.linspace(-1, 4, 50))
    assert (np.diff(got) >= 0).all() and got[0] == 0 and got[-1] == 1
    assert own.p.tolist() == pytest.approx([0, 1 / 3, 1]) and own.x.tolist() == pytest.approx([0, 4 / 3, 3])


def test_obfuscated_words_are_revealed():
    assert toxicity.revealed("id!0t") == "idiot" and toxicity.revealed("m.o.r.o.n") == "moron" and toxicity.revealed("$cum") == "scum"
    own = toxicity.Features({"idiot": 5.0, "scum": 4.0})
    x = own(pa.array(["you id10t", "idiot", "nothing here", ""]))
    named = dict(zip(toxicity.NAMES, x.T))
    assert named["revealed_density"].tolist() == [0.5, 0, 0, 0] and named["near_count"][0] > 0 == named["near_count"][1]


def test_linear_time_score_equals_all_pairs():
    rnd = np.random.default_rng(1)
    machine = quality_model.Machine(0.3, rnd.normal(size=quality_model.FEATURES), rnd.normal(size=(quality_model.FEATURES, quality_model.RANK)))
    texts = pa.array(["some words and some more", "", "ONE!! $$$"])
    features, values, bounds = quality_model.Vectors()(texts)
    got = machine.margin(features, values, bounds)
    for row in range(3):
        f, x = features[bounds[row] : bounds[row + 1]], values[bounds[row] : bounds[row + 1]]
        want = 0.3 + (machine.weight[f] * x).sum() + sum((machine.factor[f[i]] @ machine.factor[f[j]]) * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert got[row] == pytest.approx(want)


def test_held_out_toxic_documents_are_found_and_told_apart(spark):
    rows = queries.op1_toxicity(spark, LARGER).toPandas().merge(pd.read_parquet(f"{LARGER}/labels.parquet"), on="doc_id")
    judged = rows[rows.held_out]
    toxic, clean = judged[judged.toxic == 1], judged[judged.toxic == 0]
    assert toxic.predicted.mean() >= 0.7 and clean.predicted.mean() <= 0.02
    auc = ((toxic.score.to_numpy()[:, None] > clean.score.to_numpy()[None, :]) + 0.5 * (toxic.score.to_numpy()[:, None] == clean.score.to_numpy()[None, :])).mean()
    assert auc >= 0.97


def features_by_hand(text, lexicon):
    """Some of the features of one text, token by token."""
    tokens = text.split()
    own = [toxicity.Features(lexicon).attributes(t) for t in tokens]
    hits = [a[1] > 0 for a in own]
    near = sum(h and any(own[j][4] for j in range(max(0, i - 5), min(len(own), i + 6))) for i, h in enumerate(hits))
    words = max(1, len(tokens))
    return sum(hits) / words, max([a[1] for a in own], default=0), near / words, sum(a[4] for a in own) / words, sum(a[10] for a in own) / words, np.log1p(len(tokens))


def test_features_equal_a_count_by_hand_in_any_blocks(monkeypatch):
    from veldra.llm import token_table

    rnd = random.Random(6)
    words = ["you", "YOUR", "scum", "sc.um", "$cum", "id10t", "calm", "Day!", "a", "soooo", "42", "#"]
    texts = ["", *(" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(40))]
    lexicon = {"scum": 4.0, "idiot": 5.0}
    names = ("lexicon_density", "lexicon_weight", "near_density", "second_person", "obfuscated", "log_words")
    for block in (token_table.TOKEN_BLOCK, 7):
        monkeypatch.setattr(token_table, "TOKEN_BLOCK", block)
        x = toxicity.Features(lexicon)(pa.array(texts))
        got = np.stack([x[:, toxicity.NAMES.index(n)] for n in names], axis=1)
        assert got == pytest.approx(np.array([features_by_hand(t, lexicon) for t in texts]))


def test_scores_equal_trees_walked_by_hand():
    rnd = np.random.default_rng(3)
    x = rnd.random((400, 4))
    y = (x[:, 0] + 0.3 * rnd.random(400) > 0.6).astype(float)
    trees = toxicity.fit_trees(x, y)
    for row in x[:50]:
        total = trees.base
        for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
            node = 0
            for _ in range(toxicity.DEPTH):
                node = 2 * node + 1 + (row[feature[node]] > cut[node])
            total += leaf[node - (2**toxicity.DEPTH - 1)]
        assert trees(row[None, :])[0] == pytest.approx(total)


def test_scores_of_one_step_keep_the_order_of_margins():
    model = toxicity.Model({}, lambda x: x[:, 0], toxicity.Isotonic(np.array([-1.0, 1.0]), np.array([0.0, 1.0])), 0.5)
    model.features = lambda texts: np.array([[float(t)] for t in texts.to_pylist()])
    scores = model.score(pa.array(["-3", "-2", "0", "2", "3"]))
    assert (np.diff(scores) > 0).all() and 0 < scores[0] < 0.01 and 0.98 < scores[-1] < 1
