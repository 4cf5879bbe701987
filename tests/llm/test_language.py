"""Language identification against a plain word-by-word computation."""

import random
import re

import numpy as np
import pytest
import regex

from emberfield.llm import language_backoff as lb


def _plain(text, model):
    """Language and score of one text: a loop over words, n-grams as strings."""
    (vocabulary, logs), width = model["tables"][0], len(model["languages"])
    sums, known, seen = np.zeros(width), 0, 0
    for word in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        for term in regex.findall(r"\p{L}+", word.lower()):
            seen += 1
            if term in vocabulary:
                sums, known = sums + logs[vocabulary[term]], known + 1
                continue
            for order in range(lb.ORDERS, 0, -1):
                grams, own_logs = model["tables"][order]
                own = lb.grams(term, order)
                found = [grams[g] for g in own if g in grams]
                if found and 2 * len(found) >= len(own):
                    sums, known = sums + own_logs[found].mean(axis=0), known + 1
                    break
    if not seen:
        return "und", 0.0
    power = np.exp(sums / np.sqrt(max(known, 1)) - (sums / np.sqrt(max(known, 1))).max())
    return model["languages"][int(power.argmax())], power.max() / power.sum()


def _texts(seed, n, alphabet, words):
    rng = random.Random(seed)
    pool = ["".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(words)]
    return [" ".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("terms", [30, 20_000])
def test_backoff_equals_a_plain_loop(spark, terms):
    alphabets = {"aa": "abcdefgé", "bb": "cdefghijß", "cc": "дежзийab", "dd": "漢字仮名𝒳ab"}
    learned = [(t, lang) for i, (lang, a) in enumerate(alphabets.items()) for t in _texts(i, 60, a, 150)]
    rows = [(i, t, lang) for i, (t, lang) in enumerate(learned)]
    model = lb.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), terms=terms)
    texts = [t for i, a in enumerate(alphabets.values()) for t in _texts(i, 10, a, 150) + _texts(i + 50, 40, a, 400)]
    texts += ["", None, "12 --", "zzzzqqq", "Abc-DEF,gé 9a", "ΑΣ ΑΣ. ÀB", "<ab> >a<", " ".join(texts[:40]) * 40, texts[3], texts[3]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lb.predict(docs, model).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        lang, score = _plain(text, model)
        assert got[i][1] == pytest.approx(score, abs=2e-3)
        assert got[i][0] == lang or abs(got[i][1] - 1 / len(alphabets)) < 0.3


def test_known_words_and_counts_per_word():
    words = [b"ab,cd", b"12", b"ab"]
    model = {
        "languages": ["x", "y"],
        "tables": [({"ab": 0}, np.array([[1.0, 2.0]], np.float32))] + [({}, np.zeros((0, 2), np.float32))] * lb.ORDERS,
    }
    model["steps"] = lb._steps([v for v, _ in model["tables"]])
    assert lb.word_scores(words, model).tolist() == [[1, 2, 1, 2], [0, 0, 0, 0], [1, 2, 1, 1]]
