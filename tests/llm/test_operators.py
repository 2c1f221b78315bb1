import hashlib
import re

import numpy as np
import pytest

from latticework.llm import chat_format, decontaminate, language_id, license_scan, mixing, near_dedup, quality, secret_scan, substring_dedup, topk_search
from latticework.llm.shared import components
from latticework.llm.tokens import AS_IS, SPACED, Words

from . import fixtures as fx


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(fx.documents(), fx.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], fx.SCHEMA)


def pairs():
    return [(r[0], r[1]) for r in fx.documents()]


def test_words_match_regular_expressions():
    for text in [t or "" for _, t in pairs()]:
        data = np.frombuffer(text.encode(), np.uint8)
        w = Words(data, np.array([0, len(data)]), SPACED, AS_IS)
        assert [data[a:b].tobytes() for a, b in zip(w.starts, w.ends)] == fx.spaced(text)
    both = np.frombuffer(b"abab", np.uint8)
    w = Words(both, np.array([0, 2, 2, 4]), SPACED, AS_IS)
    assert w.counts().tolist() == [1, 0, 1] and w.hashes[0] == w.hashes[1]


def test_substring_dedup(docs, empty):
    got = substring_dedup.remove_repeats(docs).collect()
    want = fx.repeats(pairs())
    assert len(got) == len(fx.documents())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_dedup_null_id(spark):
    text = " ".join(f"w{k}" for k in range(20))
    rows = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame([(None, text), (5, text), (9, text)], "doc_id long, text string")).collect()}
    assert rows == {5: 0, 9: 20, None: 20}


def test_near_dedup(docs, empty):
    got = near_dedup.near_duplicates(docs).collect()
    want = fx.classes(pairs())
    assert len(got) == len(fx.documents())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0


def test_near_dedup_null_id(spark):
    rows = near_dedup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (1, "A b c d e f")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id, r.kept) for r in rows} == {(None, None, True), (2, 1, False), (1, 1, True)}


def test_large_family_over_blocks(spark, monkeypatch):
    """A family that is cut into many blocks has the classes of brute force."""
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 7)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(60):
        w = list(base)
        for j in range(k % 9):
            w[(k * 7 + j * 11) % 80] = f"e{k}_{j}"
        rows.append((k, " ".join(w)))
    got = {r.doc_id: tuple(r)[1:] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == fx.classes(rows)


def test_likelihood_peaks_at_similarity():
    draw = np.random.default_rng(1)
    common, a, b = (draw.integers(0, 1 << 63, n).astype(np.uint64) for n in (600, 200, 200))
    x, y = near_dedup.registers(np.concatenate([common, a])), near_dedup.registers(np.concatenate([common, b]))
    grid = np.linspace(0, 0.99, 100)
    best = grid[np.argmax([near_dedup.log_likelihood(j, 800.0, 800.0, (x > y).sum(), (x < y).sum()) for j in grid])]
    assert abs(best - 0.6) < 0.12
    merged = np.maximum(near_dedup.registers(common), near_dedup.registers(a))
    assert (merged == x).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    assert got == {k: 1 for k in range(1, 41)} | {100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0


def items():
    texts = [t for _, t in pairs() if t]
    return [(1, " ".join(texts[11].split()[20:50])), (2, "ONE"), (10, "three little"), (3, None), (4, ""), (5, "never seen anywhere at all in these documents of ours today"), (1, " ".join(texts[11].split()[20:50])), (None, "two words")]


def test_decontaminate(spark, docs, empty):
    bench = spark.createDataFrame(items(), "item_id long, text string")
    got = decontaminate.decontaminate(docs, bench).collect()
    want = fx.contamination(pairs(), [x for x in items() if x[0] is not None])
    assert len(got) == len(fx.documents())
    assert all(tuple(r)[1:] == want[r.doc_id] for r in got)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert not decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count()


def test_decontaminate_by_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 100)
    got = decontaminate.decontaminate(docs, spark.createDataFrame(items(), "item_id long, text string")).collect()
    want = fx.contamination(pairs(), [x for x in items() if x[0] is not None])
    assert len(got) == len(fx.documents()) and all(tuple(r)[1:] == want[r.doc_id] for r in got)


def test_proximity_matches(spark):
    docs = spark.createDataFrame([(1, "a b x c d"), (2, "a b c d"), (3, "d c b a q q q"), (4, "a b c q q q q q d")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b c d")], "item_id long, text string")
    near = lambda slop: {r.doc_id for r in decontaminate.search(docs, bench, slop).where("size(items) > 0").collect()}
    assert near(0) == {2} and near(1) == {1, 2} and near(5) == {1, 2, 4}


def test_secret_scan(spark, docs, empty):
    key = "AKIA" + "Z" * 16
    texts = {1: f'é password="hunter22" token: {"0123456789abcdef" * 2}', 2: f"x {key} y AKIASHORT api-key API_KEY=abcdef", 3: "SECRET = 'abc' secret=abcdefg" + "f" * 30, 4: None, 5: "", 6: "deadbeef" * 3, 7: "deadbeef" * 3, 8: "passwordſ=abcdefgh"}
    texts[9] = "Zx9" + "aB3" * 12
    rows = [(i, t, f"s{i % 4}", "clash") for i, t in texts.items()]
    found = secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, owner string, spans string"))
    got = {r.doc_id: r.spans for r in found.collect()}
    pattern = re.compile(secret_scan.ASSIGN.decode(), re.I | re.A)
    for i, t in texts.items():
        t = t or ""
        want = [(m.start(), 0, m.end()) for m in pattern.finditer(t) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert [(s.start, s.kind, s.end) for s in got[i] if s.kind < 3] == sorted(want)
    assert [(s.kind, s.start, s.end) for s in got[9]] == [(3, 0, 39)]
    assert got[6][0].owners == 2 and got[6][0].repositories == 2
    assert secret_scan.scan(empty).count() == 0
    assert secret_scan.scan(docs).count() == len(fx.documents())


def test_widely_copied_secret_is_an_example(spark):
    rows = [(i, "token=" + "abcdef12", f"s{i}") for i in range(5)] + [(9, "token=mine1234", "s1")]
    got = {r.doc_id: [s.live for s in r.spans] for r in secret_scan.scan(spark.createDataFrame(rows, "doc_id long, text string, owner string")).collect()}
    assert got == {i: [False] for i in range(5)} | {9: [True]}


def test_chat_format_round_trip(spark):
    hard = "\\### Assistant: </turn> ok <turn>user\n\\\\s \\o </turn>\n<next> 𝄞"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", "second"), (1, 3, "user", None), (2, 1, "assistant", ""), (2, 0, None, "x"), (3, 0, "od<turn>d\nrole\\", "y"), (None, 0, "user", "n"), (4, 1, "user", "same"), (4, 1, "user", "same")]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    chats = chat_format.format_chats(turns)
    got = {r.conv_id: r for r in chat_format.read_back(chats).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])]
        assert [(t.role, t.text) for t in got[conv].turns] == want
        assert got[conv].learned_text == "".join(t for r, t in want if r == "assistant")
    assert got[1].formatted.count("<turn>") == 3
    assert chat_format.format_chats(turns.limit(0)).count() == 0


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    words = [(r[0], len(fx.spaced(r[1])), r[3]) for r in fx.documents()]
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((i, n) for i, n, _ in words)
    size = {}
    for _, n, s in words:
        size[s] = size.get(s, 0) + n
    names = sorted(size, key=lambda s: (s is None, s))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, capped = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in capped)) / sum(weight[s] for s in names if s not in capped)
        new = {s for s in names if s not in capped and level * weight[s] > 3 * size[s]}
        if not new:
            break
        capped |= new
    target = {s: 3 * size[s] if s in capped else level * weight[s] for s in names}
    of = {i: s for i, _, s in words}
    taken = {}
    for r in rows:
        assert r.taken <= 3 * r.size and r.source_size == size[of[r.doc_id]]
        assert abs(r.target - target[of[r.doc_id]]) < 1e-6
        taken[of[r.doc_id]] = taken.get(of[r.doc_id], 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK for s in names)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0
    assert {r.taken for r in mixing.mix(docs.where("text is null")).collect()} == {0}


def test_apportion_is_sainte_lague(spark):
    claims = {"a": 53.0, "b": 24.0, "c": 23.0, "d": 0.0, "e": 1.5}
    for house in (0, 1, 7, 50, 333):
        rows = spark.createDataFrame([(k, v, house, 0) for k, v in claims.items()], "name string, claim double, house long, whole int")
        got = {r["name"]: r.seats for r in mixing.apportion(rows, "claim", "house", ["whole"], ["name"], "seats").collect()}
        want = dict.fromkeys(claims, 0)
        for _ in range(house):
            want[max(claims, key=lambda k: (claims[k] / (want[k] + 0.5), -ord(k)))] += 1
        assert got == want


def test_targets_reshare_the_excess(spark):
    sizes = {"a": 10, "b": 1000, "c": 1, "d": 500}
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["c"] == 3 and abs(sum(got.values()) - sum(sizes.values())) < 1e-6
    assert abs(got["b"] - 2 * got["d"]) < 1e-6


def language_rows():
    import random

    draw = random.Random(3)
    parts = {"en": ["the", "ing", "tion", "wh", "ed"], "fr": ["eau", "é", "ment", "ou", "que"], "de": ["sch", "ung", "ß", "ei", "keit"]}
    return [(k, " ".join("".join(draw.choice(parts[lang]) for _ in range(3)) for _ in range(draw.randrange(3, 60))), lang, "clash") for k in range(400) for lang in [("en", "fr", "de")[k % 3]]]


def test_language_id(spark, docs, empty):
    rows = spark.createDataFrame(language_rows(), "doc_id long, text string, lang string, score string")
    model = language_id.fit(language_id.learning_rows(rows))
    got = language_id.predict(rows, model, ["doc_id", "lang", "score"], "_p", "_s")
    held = got.where("pmod(crc32(cast(doc_id as string)), 5) = 0").collect()
    assert sum(r._p == r.lang for r in held) >= 0.97 * len(held) and all(0 <= r._s <= 1 for r in held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !?"), (4, "éé"), (5, "日本")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred != "und" for r in language_id.predict(odd, model, ["doc_id"]).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    nothing = language_id.fit(language_id.learning_rows(empty))
    assert {r.lang_pred for r in language_id.predict(docs, nothing, ["doc_id"]).collect()} == {"und"}
    assert language_id.predict(empty, model, ["doc_id"]).count() == 0


def test_rare_languages_are_learned(spark):
    """With more than 200 languages, the rarest are still told apart."""
    import random

    draw = random.Random(9)
    words, letters, rows = [t for _, t, _, _ in language_rows()[:30]], "abcdefghijklmnopqrstuvwxyz", []
    for k in range(230):
        own = str.maketrans(letters, "".join(draw.sample(letters, 26)))
        for _ in range(8 if k >= 200 else 14):
            rows.append((len(rows), " ".join(draw.sample(words, 3)).translate(own), f"l{k:03}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = language_id.fit(language_id.learning_rows(docs))
    got = language_id.predict(docs, model, ["lang"]).where("lang >= 'l200'").collect()
    assert len(model[0]) == 230 and sum(r.lang_pred == r.lang for r in got) >= 0.95 * len(got)


def test_language_kernel_folds_into_the_matrix():
    """Scores by the folded matrix are those of the kernel expansion over landmarks."""
    texts = [t for _, t, _, _ in language_rows()[:20]]
    raw = "".join(texts).encode()
    ends = np.cumsum([0, *[len(t.encode()) for t in texts]])
    x = language_id.presence(np.frombuffer(raw, np.uint8), ends)
    one = [language_id.presence(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0] for t in texts]
    assert (x == np.stack(one)).all()


def test_quality(spark, docs, empty):
    draw = np.random.default_rng(2)
    good = lambda: " ".join(draw.choice(["the", "house", "stands", "by", "water", "and", "trees"], 40))
    bad = lambda: " ".join(f"{w}$$$" for w in draw.choice(["the", "house", "stands", "by"], 40))
    rows = [(k, good() if k % 3 else bad(), "clash") for k in range(600)]
    table = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(500)] + [(7, None), (None, 1), (8, 5)], "doc_id long, label int")
    model = quality.fit(table, labels)
    got = {r.doc_id: r.score for r in quality.score(table, model).collect()}
    held = [k for k in got if k >= 500]
    assert all((got[k] >= 0.7) == (k % 3 > 0) for k in held) and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, model).count() == len(fx.documents())
    assert quality.score(empty, model).count() == 0
    flat = quality.fit(table, labels.limit(0))
    assert {round(r.score, 6) for r in quality.score(docs, flat).collect()} == {0.5}


def test_hinge_descent_separates():
    rows = [np.array([k % 2, 2 + k % 5]) for k in range(40)]
    w, c = quality.descend(rows, np.ones(quality.DIMENSIONS), np.array([1 if k % 2 else -1 for k in range(40)]))
    assert all((w[r].sum() / np.sqrt(2) + c > 0) == (r[0] == 1) for r in rows)


def test_license_scan(spark, docs, empty):
    texts = [(1, "Intro.\nLicensed under the Apache License, Version 2.0.\nEnd"), (2, "released under the MIT license"), (3, None), (4, ""), (5, "Licensed under the moon."), (6, "Released under the MIT License."), (6, "Released under the MIT License.")]
    rows = spark.createDataFrame([(*t, "clash") for t in texts], "doc_id long, text string, words string")
    got = sorted((r.doc_id, r.unit, r.license, r.dice) for r in license_scan.scan(rows).collect())
    # The first text as a whole has two more bigrams than the template.
    assert got == [(1, -1, "Apache-2.0", 0.875), (1, 1, "Apache-2.0", 1.0), (2, -1, "MIT", 1.0), (2, 0, "MIT", 1.0)] + [(6, -1, "MIT", 1.0)] * 2 + [(6, 0, "MIT", 1.0)] * 2
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == 0


def test_license_runs(spark):
    """Full texts, wrapped notices and notices inside a line, as brute force over all runs of words finds them."""
    import random

    draw = random.Random(2)
    prose = lambda n: " ".join(draw.choice(fx.WORDS) for _ in range(n))
    full = dict(license_scan.FULL_TEXTS)
    gpl = license_scan.TEMPLATES[6][1].split()
    wrapped = "\n".join("# " + " ".join(gpl[k : k + 7]) for k in range(0, len(gpl), 7))
    edited = " ".join(w for k, w in enumerate(gpl) if k % 17 != 5)
    texts = {1: "Copyright (c) 2020 Some One\n\n" + full["MIT"], 2: prose(60) + "\n" + wrapped + "\n" + prose(60), 3: prose(50) + " Released under the MIT License. " + prose(50)}
    texts |= {4: prose(40) + " " + edited + " " + prose(40), 5: "Released under the MIT License.\n\n" + prose(70) + "\n" + wrapped, 6: prose(300), 7: " ".join(f"w{k}" for k in range(900)) + "\n" + full["Apache-2.0"] + "\n" + " ".join(f"v{k}" for k in range(900))}
    rows = license_scan.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    # The full text has a line that is a short notice.
    line = next(k for k, l in enumerate(texts[7].split("\n")) if "Licensed under the Apache License" in l)
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.unit, r.license))
    assert got == {1: {(-1, "MIT")}, 2: {(-62, "GPL-3.0")}, 3: {(-52, "MIT")}, 4: {(-42, "GPL-3.0")}, 5: {(0, "MIT"), (-77, "GPL-3.0")}, 7: {(-902, "Apache-2.0"), (line, "Apache-2.0")}}
    dice = {r.doc_id: r.dice for r in rows}
    for i, k in ((3, 8), (4, 6)):
        w, b = license_scan.words_of(texts[i]), set(license_scan.bigrams_of(license_scan.TEMPLATES[k][1]))
        assert dice[i] == round(max(2 * len(b & set(zip(w[x:y], w[x + 1 : y]))) / (len(b) + len(set(zip(w[x:y], w[x + 1 : y])))) for x in range(len(w)) for y in range(x + 2, len(w) + 1)), 6)


def test_topk_search(spark):
    draw = np.random.default_rng(5)
    vectors = draw.normal(size=(400, 64)).astype(float)
    vectors[100:110] = vectors[0]
    rows = [(k, v.tolist(), "clash") for k, v in enumerate(vectors)] + [(500, None, "c"), (None, vectors[3].tolist(), "c"), (600, [], "c"), (700, [1.0, None] * 40, "c")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string")
    got = {}
    for r in topk_search.search(table, table.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    bits = {(1 << 63) - 1 if i is None else i: np.array([x is not None and x > 0 for x in (v + [0.0] * 64)[:64]]) for i, v, _ in rows if v is not None}
    for q in (0, 100, 200, 300, 600, 700):
        want = sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:10]
        assert sorted(got[q]) == want
    assert 500 not in got
    assert topk_search.search(table.limit(0), table).count() == 0


def test_topk_search_of_wide_vectors(spark, tmp_path):
    """Components past the 64th count."""
    vectors = [[1.0] * 64 + [1.0 if j < k else -1.0 for j in range(40)] for k in range(30)]
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted((r["rank"], r.vec_id, r.distance) for r in topk_search.op5_topk_search(spark, str(tmp_path)).collect())
    assert got == [(k + 1, k, k) for k in range(10)]
    assert {r.distance for r in topk_search.search(*[spark.read.parquet(f"{tmp_path}/embeddings.parquet")] * 2).collect()} == {0}


def test_digest_columns_read_from_output(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat_format.op1_chat_format(spark, str(tmp_path)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nhi\nassistant\nyo\n").hexdigest()
    assert got[-7].loss_chars == len(chat_format.EXTRA) and got[-7].n_turns == 2
