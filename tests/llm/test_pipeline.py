import random

import pytest

import corpus_pipeline

from . import fixtures as fx

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the house stands by water and trees while people walk along old roads under bright skies with quiet dogs jumping over lazy foxes".split()


def permuted(languages: int, each: int) -> list[tuple]:
    """Documents of languages that differ by a permutation of their letters."""
    draw = random.Random(7)
    letters, rows = "abcdefghijklmnopqrstuvwxyz", []
    for k in range(languages):
        own = str.maketrans(letters, "".join(draw.sample(letters, 26)))
        for _ in range(each):
            rows.append((len(rows), " ".join(draw.choice(WORDS) for _ in range(60)).translate(own), f"l{k:03}", "s", 0))
    return rows


@pytest.mark.parametrize(("languages", "each"), [(2, 40), (100, 12)])
def test_language_stage_at_any_number_of_languages(spark, languages, each):
    rows = permuted(languages, each)
    alien = [(-1, "Съешь же ещё этих мягких французских булок", None, "s", 0), (-2, "123 !?", None, "s", 0), (-3, None, None, "s", 0)]
    docs = spark.createDataFrame(rows + alien, SCHEMA).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs, "").collect()}
    assert {r[0] for r in rows} <= kept and not kept & {-2, -3}
    assert languages > 2 or -1 not in kept


CLASHING = SCHEMA + ", _id string, _live string, _key string, key string, kept string, row string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, *["c"] * 6) for r in rows], CLASHING).repartition(3)


def awkward() -> list[tuple]:
    """The documents of the fixtures, among them nulls, empty texts and a repeated row, as rows of the pipeline."""
    return [(r[0], r[1], r[2], r[3], r[4]) for r in fx.documents()]


def test_near_dedup_stage(spark):
    """Rows without an id, and rows that share one, are judged as rows: one of each class stays, and no other is lost."""
    rows = awkward()[:-1] + [(None, "a text without an id", "en", "s", 20)] * 3 + [(None, rows_of(12), "en", "s", 1), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0)]
    rows += [(9001, rows_of(13), "en", "s", 1), (9001, "quite another text with the same id as a copy", "en", "s", 1), (9001, "quite another text with the same id as a copy", "en", "s", 1)]
    want = fx.classes([(r[0], r[1]) for r in awkward()])
    kept = [r for r in awkward()[:-1] if want[r[0]][2]]
    kept += [(None, "a text without an id", "en", "s", 20), (None, "", "en", "s", 0), (None, None, "en", "s", 0), (None, None, "en", "s", 0), (9001, "quite another text with the same id as a copy", "en", "s", 1)]
    got = corpus_pipeline.drop_near_duplicates(spark, clashing(spark, rows), "")
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == sorted(kept, key=str)


def rows_of(k: int) -> str:
    """A text of the fixtures that others resemble."""
    return awkward()[k][1]


def test_decontaminate_stage(spark, tmp_path):
    """By row: a contaminated row without an id goes, and a clean one stays though another of its id goes."""
    rows = awkward() + [(None, "one", "en", "s", 3), (None, "clean", "en", "s", 3), (1, "clean words of a repeated id", "en", "s", 3), (8000, "one", "en", "s", 3), (8000, "eleven", "en", "s", 3)]
    items = [(1, " ".join(rows[11][1].split()[20:50])), (2, "ONE"), (3, None)]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = fx.contamination(list(enumerate(r[1] for r in rows)), items)
    got = corpus_pipeline.drop_contaminated(spark, clashing(spark, rows), str(tmp_path)).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted((r for k, r in enumerate(rows) if not want[k][4]), key=str)


def test_redaction_of_every_row(spark):
    """Null and repeated ids: each row loses its own secrets, and widely copied ones stay."""
    texts = [(None, "é token=mine1234 end"), (None, None), (7, "x token=first123 y token=second12"), (7, "password = third456"), (7, "nothing"), (8, "")]
    texts += [(20 + k, "token=copied12 z") for k in range(4)]
    rows = [(i, t, "en", f"s{k}", len(t or "")) for k, (i, t) in enumerate(texts)]
    out = {"é token=mine1234 end": "é <secret> end", "x token=first123 y token=second12": "x <secret> y <secret>", "password = third456": "<secret>"}
    want = [(i, out.get(t, t), lang, s, len(out.get(t, t) or "")) for i, t, lang, s, n in rows]
    got = corpus_pipeline.redact_secrets(spark, clashing(spark, rows), "").collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)


def test_run(spark, tmp_path):
    """The stages after one another, with and without rows."""
    rows = permuted(3, 30)
    rows += [(900, rows[0][1], "l000", "s", 0), (901, None, None, "s", 0), (902, rows[40][1] + " a phrase of the benchmark", "l001", "s", 0), (None, rows[70][1] + " password=hunter22", "l002", "s", 0)]
    bench = spark.createDataFrame([(1, "a phrase of the benchmark")], "item_id long, text string")
    for name, docs in (("full", rows), ("none", [])):
        spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        bench.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    # 902 and the row without an id are near duplicates of 40 and 70.
    got = corpus_pipeline.run(spark, f"{tmp_path}/full").collect()
    assert sorted((r.doc_id for r in got), key=str) == sorted(range(90), key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_run_by_row_gives_texts(spark, tmp_path):
    """Null and repeated ids, contaminated and secret-holding rows: which texts come out, and that what is taken agrees with run()."""
    rows = permuted(3, 30)
    rows += [(None, rows[5][1], "l000", "s", 0), (None, rows[35][1][::-1], "l001", "s", 0), (7, "a phrase of the benchmark " + rows[66][1][:200][::-1], "l002", "s", 0), (None, "a phrase of the benchmark", "l000", "s", 0)]
    rows += [(3, rows[3][1] + " password=hunter22", "l000", "s", 0), (200, " ".join(rows[8][1].split()[::-1]) + " password=hunter33", "l000", "s", 0)]
    bench = spark.createDataFrame([(1, "a phrase of the benchmark")], "item_id long, text string")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.training_corpus(spark, str(tmp_path)).collect()
    texts = {r.text for r in got}
    assert len(texts) == len(got) and not any("benchmark" in t or "hunter" in t for t in texts)
    assert " ".join(rows[8][1].split()[::-1]) + " <secret>" in texts
    assert all(r.taken > 0 for r in got) and texts >= {r[1] for r in rows[:90] if r[0] != 3}
    taken = {r.doc_id: r.taken for r in corpus_pipeline.run(spark, str(tmp_path)).collect() if r.doc_id is not None and r.taken}
    assert {r.doc_id: r.taken for r in got if r.doc_id is not None} == taken
