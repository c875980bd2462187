import random

import numpy as np
import pytest

from tessera.llm import langid as L

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return L.Model.fit([], [])


def brute(scores, penalty):
    """Viterbi of one sequence, state by state."""
    n, k = scores.shape
    best, back = list(map(float, scores[0])), []
    for t in range(1, n):
        step, new = [], []
        for j in range(k):
            cands = [best[i] - (penalty if i != j else 0) for i in range(k)]
            top = max(range(k), key=lambda i: best[i])
            i = top if best[top] - penalty > best[j] else j
            step.append(i)
            new.append(max(cands) + float(scores[t, j]))
        best = new
        back.append(step)
    path = [max(range(k), key=lambda i: best[i])]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1], max(best)


def test_viterbi_against_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([17, 9, 9, 4, 1])
    scores = rng.normal(0, 4, (sizes.sum(), 4)).astype(np.float32)
    got, at = L.viterbi(scores, sizes, 3.0), 0
    for n in sizes:
        s = scores[at : at + n]
        path, value = brute(s, 3.0)
        own = got[at : at + n]
        assert list(own) == path
        total = sum(float(s[t, own[t]]) for t in range(n)) - 3.0 * sum(own[t] != own[t - 1] for t in range(1, n))
        assert abs(total - value) < 1e-6
        at += n


def test_scores_against_word_by_word(model):
    from tessera.llm._text import Scan

    texts = ["The naïve Été of 12 days", "über, die", "x"]
    scan = Scan(texts)
    own, sc = model.scores(scan)
    for i, w in zip(own, sc):
        word = texts[scan.doc[i]][scan.start[i] : scan.end[i]]
        one = Scan([word])
        assert np.allclose(model.scores(one)[1][0], w, atol=1e-3), word


def test_spans_of_mixed_text(model):
    en = "this is what they would have said about the other time"
    fr = "nous sommes dans une autre ville avec les leurs depuis toujours"
    text = en + ". " + fr + ". " + "Это очень простой русский текст для проверки. " + "这是一个中文句子。"
    f = L.identify(model, [text, "", "1234 ... 99", "これは日本語の文章です", "ελληνικά είναι εδώ"])
    spans = [(model.langs[x], text[s:e]) for x, s, e in zip(f.label[: f.offsets[1]], f.start, f.end)]
    assert [x for x, _ in spans] == ["en", "fr", "ru", "zh"]
    assert spans[0][1] == en and spans[1][1] == fr
    assert f.lang[1:] == ["und", "und", "ja", "el"]


def test_held_out_accuracy_and_kept_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_model(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1")
    got = {r.doc_id: r for r in L.identify_languages(held, model).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[i].lang == x for i, x in truth.items()) >= 0.98 * len(truth)
    assert sum(r.keep for r in got.values()) >= 0.995 * len(truth)


def test_noise_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_model(docs)
    r = random.Random(5)
    noise = " ".join("".join(r.choices("qxzwvkjy", k=7)) for _ in range(60))
    assert L.identify(model, [noise]).lang == ["und"]


def test_documents_that_are_noise_for_the_most_part_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = L.fit_model(docs)
    r = random.Random(3)
    noise = lambda n: " ".join("".join(r.choices("qxzwvkjy", k=r.randint(3, 9))) for _ in range(n))
    base = [x.text for x in docs.where("length(text) between 400 and 1500").orderBy("doc_id").limit(60).collect()]
    rejected = {}
    for share in (0.25, 0.6, 0.75, 0.9):
        made = [t + " " + noise(int(len(t.split()) * share / (1 - share))) for t in base]
        rejected[share] = sum(x == L.UND for x in L.identify(model, made).lang)
    assert rejected[0.25] == 0 and all(rejected[s] >= 0.95 * len(base) for s in (0.6, 0.75, 0.9))


def test_more_labels_than_a_byte_can_count():
    r = random.Random(9)
    alphabets = ["".join(r.sample("abcdefghijklmnopqrstuvwxyz", 6)) for _ in range(200)]
    text = lambda k, n: " ".join("".join(r.choices(alphabets[k], k=5)) for _ in range(n))
    model = L.Model.fit([text(k, 200) for k in range(200)], [f"l{k:03}" for k in range(200)])
    assert len(model.langs) > 200
    f = L.identify(model, [text(k, 80) for k in range(200)])
    assert sum(x == f"l{k:03}" for k, x in enumerate(f.lang)) >= 190
    assert f.label.max() > 150


def test_edge_cases(spark, model):
    long = "the time of the other man was all that they had " * 5000
    rows = [(1, None, "a", 1), (2, "", "a", 2), (None, "this is what they said", "a", 3), (3, long, None, 4), (3, long, None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans int")
    got = L.identify_languages(df, model).collect()
    assert sorted((r.doc_id or 0, r.lang, r.keep, len(r.spans)) for r in got) == [(0, "en", True, 1), (1, "und", False, 0), (2, "und", False, 0), (3, "en", True, 1), (3, "en", True, 1)]
    kept = L.keep_identified(df, model)
    assert kept.columns == df.columns and sorted(r.spans for r in kept.collect()) == [3, 4, 4]
    assert L.identify_languages(df.limit(0), model).count() == 0
    assert L.fit_model(df.limit(0)).langs == model.langs and L.fit_model(df.drop("lang")).langs == model.langs
