import hashlib
import re

from latticework.llm import fill_in_middle as fim

from . import fixtures as fx


def brute(doc_id, text):
    """The contract, by code points."""
    t = text or ""
    h = [int(hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()[8 * k : 8 * k + 8], 16) for k in range(4)]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= 90:
        return (len(t), "plain", None, None, sha(t), sha(t))
    a, b = sorted((h[0] % (len(t) + 1), h[1] % (len(t) + 1)))
    if h[3] % 100 < 20:
        return (len(t), "spm", a, b - a, sha("<S>" + t[b:] + "<P>" + t[:a] + "<M>" + t[a:b]), sha(t))
    return (len(t), "psm", a, b - a, sha("<P>" + t[:a] + "<S>" + t[b:] + "<M>" + t[a:b]), sha(t))


AWKWARD = ["<P>", "x<S>y", "<M", "<", "<<<<<<P", "S>" * 40, "<\n" * 50, "é\U0001f926\U0001f3fc‍♂️" * 9, "\r\n \x00" * 5]


def rows():
    own = [(r[0], r[1]) for r in fx.documents()]
    return own + [(9000 + 40 * j + k, t) for k, t in enumerate(AWKWARD) for j in range(6)] + [(-7, "negative ids"), (1 << 62, "large ids"), (1 << 53 | 1, "odd beyond doubles")]


def test_every_row_against_the_contract(spark, tmp_path):
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows()], "doc_id long, text string, form string, output string, n long").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = fim.op11_fill_in_middle(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(((i, *brute(i, t)) for i, t in rows()), key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(None, "some text"), (None, None), (3, "x")], "doc_id long, text string")
    got = {r.n: r for r in fim.fill_in_middle(docs).collect()}
    assert got[9].doc_id is None and got[9].output_sha256 == brute("", "some text")[4]
    assert got[0].form == "plain" and got[0].output == ""
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_other_units(spark):
    """Words with the blanks before them, and graphemes: outputs give the texts back, and cuts fall between units."""
    texts = [(k, f"one two\n three été \U0001f926\U0001f3fc‍♂️ last{k} ") for k in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    for unit, n, ends in ((r"\s*\S+", 6, {0, 3, 7, 14, 20, 26}), (r"\X", None, None)):
        for r in fim.fill_in_middle(docs, unit).collect():
            text = dict(texts)[r.doc_id]
            assert fim.restored(r.form, r.output) == text
            assert n is None or r.n == n
            if r.form != "plain":
                assert ends is None or r.prefix_chars in ends | {len(text) - 1}
                assert not text[r.prefix_chars :].startswith("́")


def test_one_batch_of_long_text(spark):
    text = "ab\U0001f600" * 400_000
    docs = spark.createDataFrame([(k, text) for k in range(2)], "doc_id long, text string")
    assert [tuple(r) for r in fim.fill_in_middle(docs, texts=False).orderBy("doc_id").collect()] == [(k, *brute(k, text)) for k in range(2)]
