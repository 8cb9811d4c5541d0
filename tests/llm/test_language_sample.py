"""The language model learns from whole texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklake.llm import language_id
from tests.llm.test_operators import DOCS, docs


def test_model_learns_from_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(language_id, "HELD_LANGS", 1)
    r = random.Random(31)
    stock = {"aa": "the of and house river green", "bb": "und der schön straße über", "cc": "été où garçon être là"}
    rows = []
    for i in range(60):
        lang = list(stock)[i % 3]
        # the language's own words stand behind an opening of 5,000 characters that all languages share
        rows.append((i, "12345 " * 900 + " ".join(r.choices(stock[lang].split(), k=40)), lang, "s", 0))
    df = docs(spark, rows)
    model = language_id.fit(df)
    kept = {x.doc_id for x in df.where(~language_id.held_out()).select("doc_id").collect()}
    plain = language_id.Model.fit([(x[2], x[1]) for x in rows if x[0] in kept])
    assert model.langs == plain.langs and np.array_equal(model.log_p, plain.log_p)
    # without the opening
    alone = [(100 + i, " ".join(r.choices(stock[lang].split(), k=20)), lang, "s", 0) for i, lang in enumerate(stock)]
    got = {x.doc_id: x.lang_pred for x in language_id.identify(docs(spark, alone), model).collect()}
    assert got == {x[0]: x[2] for x in alone}


def test_sample_of_repeated_ids_is_bounded(spark):
    # one id with many texts, one row many times, and as many ids with a text each
    rows = [(1, f"the house w{i % 900}", "aa", "s", 0) for i in range(3000)] + [(2, "der strom", "bb", "s", 0)] * 500 + [(None, "der fluss", "bb", "s", 0)] * 5
    got = language_id.sample(spark.createDataFrame(rows, DOCS), rows=40).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got} == {"aa": 40, "bb": 2}
    assert language_id.sample(spark.createDataFrame(rows, DOCS).limit(0)).collect() == []


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MAX_LANGS", 3)
    df = spark.createDataFrame([(i, "the house", f"l{i}", "s", 0) for i in range(4)], DOCS)
    with pytest.raises(ValueError, match="languages"):
        language_id.sample(df)
    assert language_id.sample(df.where("doc_id < 3").withColumn("extra", F.lit(1))).count() == 3


def test_no_letter_is_no_language(spark):
    model = language_id.Model.fit([("aa", "the house"), ("bb", "der strom")])
    texts = ["½ ² ①", "Ⅷ Ⅸ", "१२", "\u0301\u0302", "12 !?", "ª", "ⓐ", "语", "ʰ"]
    got = {x.doc_id: x.lang_pred for x in language_id.identify(docs(spark, [(i, t, None, None, 0) for i, t in enumerate(texts)]), model).collect()}
    assert {texts[i] for i, lang in got.items() if lang != "und"} == {"ª", "语", "ʰ"}


def plain_mixture(p, members, rounds=8):
    """Proportions and log likelihood of one document's words under the members' likelihoods [langs][words]."""
    pi = {k: 1 / len(members) for k in members}
    for _ in range(rounds):
        shares = []
        for w in range(len(p[0])):
            joint = {k: pi[k] * p[k][w] for k in members}
            shares.append({k: v / sum(joint.values()) for k, v in joint.items()})
        pi = {k: max(sum(s[k] for s in shares) / len(shares), 1e-6) for k in members}
        pi = {k: v / sum(pi.values()) for k, v in pi.items()}
    return pi, sum(np.log(sum(pi[k] * p[k][w] for k in members)) for w in range(len(p[0])))


def test_inference_equals_a_plain_version():
    r = np.random.default_rng(5)
    counts = r.integers(1, 30, 40)
    scores = r.normal(-20, 6, (3, counts.sum()))
    pi, best, _ = language_id.infer(scores.copy(), counts)
    at = 0
    for d, n in enumerate(counts):
        own = scores[:, at : at + n]
        at += n
        p = np.exp(np.maximum(own - own.max(axis=0), -30))
        single = np.log(p).sum(axis=1)
        members, fit, found = [int(single.argmax())], single.max(), {int(single.argmax()): 1.0}
        while len(members) < 3:
            mixed = sum(found.get(k, 0) * p[k] for k in members)
            gains = {k: np.log(0.9 * mixed + 0.1 * p[k]).sum() for k in range(3) if k not in members}
            trial = [*members, max(gains, key=gains.get)]
            new, new_fit = plain_mixture(p, trial)
            if new_fit - fit <= 0.5 * np.log(n + 1) + 1:
                break
            members, fit, found = trial, new_fit, new
        want = np.array([found.get(k, 0) for k in range(3)])
        assert np.allclose(pi[d], want, atol=1e-9) and best[d] == want.argmax()
