"""The pipeline against plain versions of its stages, and its edge cases."""

import random

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_shingle_dedup import brute_components
from tests.llm.test_operators import DOCS, brute_contamination, odd_rows, passages

WORDS = {"aa": "the of and house river green tree stone light wind".split(), "bb": "und der schön straße über haus baum licht wind stein".split()}


def corpus(seed=1):
    r = random.Random(seed)
    bench = [(i, " ".join(f"q{r.randrange(300)}" for _ in range(30))) for i in range(5)]
    shared = [" ".join(r.choices(WORDS["aa"], k=40)) + f" mark{i}" for i in range(4)]
    rows = []
    for i in range(150):
        lang = "aa" if i % 3 else "bb"
        text = " ".join(w + str(r.randrange(30)) if r.random() < 0.3 else w for w in r.choices(WORDS[lang], k=r.randint(30, 200)))
        if i % 7 == 0:
            text = f"{text}\n{r.choice(shared)}"
        if i % 11 == 0:
            text = f"{text}\n{r.choice(bench)[1]}"
        rows.append((i, text, lang, f"s{i % 4}", len(text)))
    rows += [(200 + i, rows[i][1], rows[i][2], "copies", rows[i][4]) for i in range(20)]
    return rows, bench


def run(spark, tmp_path, rows, bench):
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        seen.append({(r.doc_id): r for r in docs.collect()} if name != "source_mixing" else docs.collect())
    return seen


def test_stages_equal_plain_versions(spark, tmp_path):
    rows, bench = corpus()
    lang, near, cut, clean, mix = run(spark, tmp_path, rows, bench)
    assert set(lang) == {r[0] for r in rows} and all(lang[r[0]].text == r[1] for r in rows)
    comps = brute_components([(r[0], r[1]) for r in rows])
    assert set(near) == {d for d, c in comps.items() if c == d} and len(near) < len(lang)
    want = brute.substring_dedup([(d, r.text) for d, r in near.items()])
    assert set(cut) == set(near)
    for d, r in cut.items():
        n, gone, digest = want[d]
        if gone:
            assert brute.hashlib.sha256(r.text.encode()).hexdigest() == digest
        else:
            assert r.text == near[d].text
        assert r.n_chars == len(r.text)
    leaks = {d for d, _ in brute_contamination([(d, r.text) for d, r in cut.items()], bench)}
    assert leaks and set(clean) == set(cut) - leaks
    assert {r.doc_id for r in mix} <= set(clean) and all(r.text == clean[r.doc_id].text for r in mix)
    sizes = {}
    for r in clean.values():
        sizes[r.source] = sizes.get(r.source, 0) + len(brute.words(r.text))
    assert abs(sum(r["size"] for r in mix) - sum(sizes.values())) <= 0.05 * sum(sizes.values())


def test_pipeline_edges(spark, tmp_path):
    rows = [*odd_rows(), (None, " ".join(passages(1, 1, 60)), "en", None, 3), (9, " ".join(passages(2, 1, 60)), "en", None, 3)]
    lang, near, cut, clean, mix = run(spark, tmp_path, rows, [(1, None), (2, "")])
    assert {1, 2, 3}.isdisjoint(lang) and {4, 5, 6, 7, 9, None} == set(lang)
    assert 7 not in near and None in near
    assert set(clean) == set(cut)


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert [len(x) for x in run(spark, tmp_path, [], [])] == [0] * 5


def test_run_applies_all_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {"shard", "doc_id", "text", "source"} <= set(out.columns) and out.count() > 0
    assert out.where("doc_id IS NULL OR text IS NULL").count() == 0
