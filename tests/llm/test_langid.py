import math
import random

import numpy as np
import pytest

from sparsemill.llm import langid
from sparsemill.llm.common import load

SYLLABLES = {"en": ["th", "ing", "the", "and"], "de": ["sch", "ein", "und", "ß"], "fr": ["eau", "é", "que", "ç"]}


def docs(n=150, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 30))), lang) for i in range(n) for lang in [rng.choice(list(SYLLABLES))]]


def test_held_out_accuracy_and_odd_rows(spark, make, odd):
    rows = [(1000 + i, t, lang) for i, t, lang in docs()]
    df = make(rows + odd)
    model = langid.train(langid.train_split(df.where("doc_id >= 1000")))
    got = langid.identify(df.withColumn("held_out", langid.held_out()), model).collect()
    assert len(got) == len(rows) + len(odd)
    held = [r for r in got if r["held_out"] and (r["doc_id"] or 0) >= 1000]
    assert len(held) > 20 and sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.95
    for r in got:
        if r["doc_id"] not in {1, 2, 3} and (r["doc_id"] is not None or r["text"]):
            assert r["lang_pred"] in SYLLABLES and 0 < r["score"] <= 1
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)
    again = langid.identify(df, langid.train(langid.train_split(df.where("doc_id >= 1000")))).collect()
    assert sorted(repr((r["doc_id"], r["lang_pred"], r["score"])) for r in again) == sorted(repr((r["doc_id"], r["lang_pred"], r["score"])) for r in got)


def test_whole_text_counts():
    text = "ab" * 400_000
    places, counts = langid.feature_counts(text)
    assert counts.sum() == len(text) + len(text) - 1 + len(text) - 2
    part = langid._PART
    try:
        langid._PART = 1000
        assert [x.tolist() for x in langid.feature_counts(text[:5003])] == [x.tolist() for x in langid.feature_counts(text[:5003])]
        small = langid.feature_counts(text[:5003])
    finally:
        langid._PART = part
    assert [x.tolist() for x in small] == [x.tolist() for x in langid.feature_counts(text[:5003])]


def test_nothing_to_learn(make):
    model = langid.train(make([(1, "a", None)]))
    assert langid.identify(make([(1, "a", None)]), model).first()["lang_pred"] == "und"
    assert langid.identify(make([]), model).count() == 0


@pytest.mark.parametrize("text, want", [("½ ² ① Ⅷ", False), ("12 34_", False), ("\u0301\u0308", False), ("٣ 〇 ☃", False), ("², x", True), ("ª", True), ("日", True), ("ǅ", True), ("ʰ", True), ("", False), (None, False)])
def test_letters(make, text, want):
    """Numerals of any kind and combining marks are no letters."""
    assert langid.has_letter(text) is want
    model = langid.train(make([(k, t, lang) for k, t, lang in docs(40)]))
    assert (langid.identify(make([(1, text)]), model).first()["lang_pred"] != "und") is want


def plain_ftrl(places, values, labels, n_lang, passes):
    """Weights by dictionaries, one coordinate at a time: {(place, language): weight}; place -1 is the bias."""
    z, n = {}, {}

    def weight(key):
        l1 = 0.0 if key[0] < 0 else langid.L1
        if abs(z.get(key, 0.0)) <= l1:
            return 0.0
        return -(z[key] - math.copysign(l1, z[key])) / ((langid.BETA + math.sqrt(n[key])) / langid.ALPHA + langid.L2)

    rng, learned = np.random.default_rng(7), np.flatnonzero(np.arange(len(labels)) % 5 != 4)
    for _ in range(passes):
        for k in rng.permutation(learned).tolist():
            x = {**dict(zip(places[k].tolist(), values[k].tolist())), -1: 1.0}
            old = {(p, j): weight((p, j)) for p in x for j in range(n_lang)}
            score = [sum(x[p] * old[p, j] for p in x) for j in range(n_lang)]
            e = [math.exp(s - max(score)) for s in score]
            for p, v in x.items():
                for j in range(n_lang):
                    g, key = (e[j] / sum(e) - (labels[k] == j)) * v, (p, j)
                    before = n.get(key, 0.0)
                    n[key] = before + g * g
                    z[key] = z.get(key, 0.0) + g - (math.sqrt(n[key]) - math.sqrt(before)) / langid.ALPHA * old[key]
    return {key: weight(key) for key in z}


@pytest.mark.parametrize("l1", [1e-3, 0.2])
def test_fit_against_dictionaries(monkeypatch, l1):
    """Every weight as the rule gives it, exact zeros where the penalty says so, and the temperature of least loss."""
    monkeypatch.setattr(langid, "L1", l1)
    rows = docs(60, seed=4)
    langs = sorted(SYLLABLES)
    found = [langid.feature_counts(t) for _, t, _ in rows]
    places, counts = [f[0] for f in found], [f[1].astype(float) for f in found]
    labels = np.array([langs.index(lang) for *_, lang in rows])
    idf = 1 + np.random.default_rng(1).random(langid.PLACES)
    model = langid.fit(langs, idf, places, counts, labels)
    vectors = [model.vector(p, c) for p, c in zip(places, counts)]
    want = plain_ftrl(places, vectors, labels, len(langs), model.passes)
    got = {(p, int(model.label[k])): model.weight[k] for p in range(langid.PLACES) for k in range(model.first[p], model.first[p + 1])} | {(-1, j): model.bias[j] for j in range(len(langs))}
    assert all(got.get(k, 0.0) == pytest.approx(w, abs=1e-6) for k, w in want.items()) and len(model.weight) == sum(w != 0 for k, w in want.items() if k[0] >= 0)
    assert l1 < 0.1 or sum(w == 0 for w in want.values()) > 100
    held = [k for k in range(len(rows)) if k % 5 == 4]
    score = np.stack([[sum(v * got.get((p, j), 0.0) for p, v in zip(places[k].tolist(), vectors[k].tolist())) + model.bias[j] for j in range(len(langs))] for k in held])
    loss = lambda t: langid.smoothed_loss(score, labels[held], t)
    assert loss(model.temperature) <= min(loss(t) for t in np.exp(np.linspace(-4, 4, 800))) + 1e-6
    assert loss(model.temperature) < min(loss(math.exp(-4)), loss(math.exp(4)))  # it lies inside


def test_temperature_lies_inside():
    """Also where all is told right, by far or hardly, and where nothing is."""
    labels = np.arange(40) % 4
    for size in (1e-9, 1e-3, 1.0, 1e4):
        t = langid.best_temperature(np.eye(4)[labels] * size, labels)
        loss = lambda x: langid.smoothed_loss(np.eye(4)[labels] * size, labels, x)
        assert loss(t) < loss(t * 1.2) and loss(t) < loss(t / 1.2)
    assert langid.best_temperature(np.zeros((0, 4)), labels[:0]) == 1.0 and langid.best_temperature(np.ones((5, 1)), np.zeros(5, int)) == 1.0
    assert langid.smoothed_loss(np.zeros((3, 2)), np.zeros(3, int), 2.0) == pytest.approx(math.log(2))


def test_weights_are_sparse_and_tell_held_out_texts(spark):
    rows = load(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.train(langid.train_split(rows))
    seen = int((model.idf < model.idf.max()).sum())
    assert len(model.weight) < 0.3 * seen * len(model.langs) and 1 < model.passes <= langid.MOST_EPOCHS
    held = [r for r in langid.identify(rows, model).collect() if r["held_out"] and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in held) / len(held) > 0.99


def test_many_labels_end_nothing(make, monkeypatch):
    """The most frequent labels are told apart, ties by name; the rest is not learned."""
    monkeypatch.setattr(langid, "MOST_LANGS", 4)
    rows = [(1000 + k, t, lang) for k, t, lang in docs(90)] + [(k, f"some junk {k}", f"l{k:02}") for k in range(30)]
    model = langid.train(make(rows))
    assert model.langs == ["de", "en", "fr", "l00"]
    monkeypatch.setattr(langid, "MOST_SAMPLE", 20)
    assert len(langid.train(make(rows)).langs) == 4
