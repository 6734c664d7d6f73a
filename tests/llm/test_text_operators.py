"""The operators on texts: small cases with nulls, empty, long and repeated rows, and brute-force versions."""

import collections
import heapq
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sightline.llm import langid, licences, linear, mixing, near, pieces, quality, queries, ragged

MODEL = queries.PIECE_MODEL
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int"


def docs(spark, texts, langs=None):
    """Rows with two extra columns whose names some operator gives as well."""
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "s", len(t or ""), "old", 1) for i, t in enumerate(texts)], SCHEMA)


ODD = [None, "", " \n\t ", "a", "x" * 60_000, "same words here", "same words here", "日本語のテキスト 😀▁", "one two three four five six " * 500]


# --- ragged kernels --------------------------------------------------------------------------------------------------


def test_words_and_hashes():
    texts = ["a b  cde\n", "", None, "é ß", "  b"]
    data, offs = ragged.buffer_of(pa.array(texts))
    starts, ends, rows = ragged.words(data, offs)
    got = [[data[s:e].tobytes().decode() for s, e in zip(starts[a:b], ends[a:b], strict=True)] for a, b in itertools.pairwise(rows)]
    assert got == [(t or "").split() for t in texts]
    h = ragged.span_hashes(data, starts, ends)
    assert h[1] == h[-1] and len(set(h.tolist())) == 5


def test_chunks_keep_all_rows():
    b = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in (5, 100, 1, 0, 7)])], ["text"])
    assert [c.num_rows for c in ragged.chunks(iter([b]), "text", 10)] == [1, 1, 3]


# --- quality ---------------------------------------------------------------------------------------------------------


def rules(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(tri)
    inside = {i + k for i, t in enumerate(tri) if n[t] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def test_rules_by_brute_force(spark):
    rng = random.Random(0)
    texts = ODD + ["".join(rng.choice(["ab", "é", " ", " ", "\n", "#", "c ", "d e f ", "\v"]) for _ in range(rng.randrange(400))) for _ in range(60)]
    got = {r["doc_id"]: r for r in quality.assess(docs(spark, texts), None).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        r, want = got[i], rules(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, repr(t)[:80]
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r["kept"] is (not r["base_failed"]) and r["source"] == "s"


def test_quality_on_held_out_rows(spark):
    rng = random.Random(1)
    good, bad = [f"w{i}" for i in range(300)], [f"$$z{i}" for i in range(300)]
    text = lambda v: " ".join(rng.choice(v) for _ in range(80))
    d = docs(spark, [text(bad if i % 3 == 0 else good) for i in range(240)])
    labels = spark.createDataFrame([(i, int(i % 3 > 0), None) for i in range(120)] + [(None, 1, 0), (3, None, 0), (5, 9, 0)], "doc_id long, quality int, toxic int")
    out = quality.assess(d, quality.train(d, labels)).filter("doc_id >= 120").collect()
    assert np.mean([r["kept"] == (r["doc_id"] % 3 > 0) for r in out]) == 1.0
    assert quality.train(d, labels.limit(0)) is None and quality.assess(d.limit(0), None).count() == 0


def test_probabilities_are_calibrated():
    z = np.array([[4.0, 0.0]] * 60 + [[0.0, 4.0]] * 40)
    y = np.array([0] * 45 + [1] * 15 + [1] * 30 + [0] * 10)
    scale, shift = linear.calibrate(z, y, 2, 3000)
    p = linear.softmax(z * scale + shift)
    assert p[0, 0] == pytest.approx(0.75, abs=0.03) and p[-1, 1] == pytest.approx(0.75, abs=0.03)


# --- language --------------------------------------------------------------------------------------------------------


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    for _ in range(40):
        sizes = rng.integers(0, 40, 9)
        rows = np.concatenate([[0], np.cumsum(sizes)])
        s = -np.abs(rng.normal(0, 3, (rows[-1], 3)))
        s += np.where(rng.integers(0, 3, rows[-1] // 8 + 1)[np.arange(rows[-1]) // 8][:, None] == np.arange(3), 0, -2)
        out = langid.viterbi(s, rows)
        for a, b in itertools.pairwise(rows):
            if a < b:
                v = s[a].copy()
                for t in range(a + 1, b):
                    v = np.maximum(v, v.max() - langid.SWITCH) + s[t]
                p = out[a:b]
                assert s[np.arange(a, b), p].sum() - langid.SWITCH * (p[1:] != p[:-1]).sum() == pytest.approx(v.max())


def test_language_spans_and_scripts(spark):
    rng = random.Random(2)
    words = {"aa": ["kata", "moli", "rasu", "neto"], "bb": ["schurf", "kraght", "plomsch", "grind"], "ru": ["слово", "дело", "город"]}
    make = lambda lang, n=40: " ".join(rng.choice(words[lang]) for _ in range(n))
    langs = {i: sorted(words)[i % 3] for i in range(60)}
    d = docs(spark, [make(langs[i]) for i in range(60)], langs)
    model = langid.train(d.select("doc_id", "text", "lang"))
    assert model.langs == ["aa", "bb", "ru"]
    texts = [make("aa") + " " + make("bb", 30), make("ru"), "12 345 ...", None, "", "слово kata", *ODD]
    got = {r["doc_id"]: r for r in langid.label(docs(spark, texts), model).collect()}
    assert [(s["start"], s["end"], s["lang"]) for s in got[0]["spans"]] == [(0, 40, "aa"), (40, 70, "bb")]
    assert got[0]["lang_pred"] == "aa" and got[0]["score"] == pytest.approx(4 / 7)
    assert got[1]["lang_pred"] == "ru" and got[1]["score"] == 1
    for i in (2, 3, 4):
        assert got[i]["lang_pred"] == "und" and got[i]["score"] == 0 and got[i]["spans"] == []
    empty = langid.train(d.limit(0).select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in langid.label(docs(spark, texts), empty).collect()} == {"und"}


def test_letters_of_all_planes(spark):
    """A text of letters beyond the third plane has a language; symbols there have none."""
    d = docs(spark, ["kata moli rasu"] * 4, {i: "aa" for i in range(4)})
    model = langid.train(d.select("doc_id", "text", "lang"))
    got = [r["lang_pred"] for r in langid.label(docs(spark, ["\U00030000\U00031350 \U000323af", "\U0001f600 \U000e0100"]), model).orderBy("doc_id").collect()]
    assert got == ["aa", "und"]


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = queries.op5_language(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")).alias("a"), F.count("*").alias("n")).first()
    assert out.count() == d.count() and r["n"] > 200 and r["a"] > 0.98


# --- near-duplicates -------------------------------------------------------------------------------------------------


def set_of(text):
    w = [x for x in re.split(r"[ \t\n\v\f\r]+", "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "").lower())) if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def jp(a, b):
    if all(v == 1 for v in a.values()) and all(v == 1 for v in b.values()):
        return len(a.keys() & b.keys()) / max(1, len(a.keys() | b.keys()))
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in set(a) | set(b)) for i in a if i in b)


def truth(texts):
    sets = [set_of(t) for t in texts]
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and len(sets[i].keys() & sets[j].keys()) * 4 >= min(len(sets[i]), len(sets[j])) and jp(sets[i], sets[j]) >= 0.8 - 1e-9:
            p, q = find(i), find(j)
            parent[max(p, q)] = min(p, q)
    return {i: find(i) for i in range(len(texts))}


def noisy(rng, base, edits):
    w = base[:]
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"n{rng.randrange(10**6)}"
    return " ".join(w)


def test_sketches_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    a, b = np.arange(30, dtype=np.uint64), np.arange(10, 45, dtype=np.uint64)
    x, y = rng.integers(1, 5, 30), rng.integers(1, 5, 35)
    want = near.probability_jaccard(a, x, b, y)
    assert want == pytest.approx(jp(dict(zip(a.tolist(), x.tolist(), strict=True)), dict(zip(b.tolist(), y.tolist(), strict=True))))
    est = [(lambda s: (s[0] == s[1]).mean())(near.sketch(np.concatenate([ragged.mix(a + np.uint64(k << 20)), ragged.mix(b + np.uint64(k << 20))]), np.concatenate([x, y]), np.array([0, 30, 65]))) for k in range(60)]
    assert np.mean(est) == pytest.approx(want, abs=0.02)


def test_classes_by_brute_force(spark):
    rng = random.Random(4)
    bases = [[f"b{k}w{rng.randrange(400)}" for _ in range(120)] for k in range(6)]
    texts = [noisy(rng, b, rng.choice([0, 1, 2, 4, 7])) for b in bases for _ in range(12)] + ODD
    texts += ["A, b c. D e f!", "a b c d e F", "tiny", "Tiny!", "echo " * 400, "echo " * 380]
    got = {r["doc_id"]: r for r in near.classes(docs(spark, texts)).collect()}
    assert {i: r["class_id"] for i, r in got.items()} == truth(texts)
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())
    assert near.classes(docs(spark, []).limit(0)).count() == 0
    nulls = near.classes(spark.createDataFrame([(None, "a b c"), (4, "a b c")], "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["class_id"]) for r in nulls} == {(None, None), (4, 4)}


def test_large_groups_lose_no_link(spark, monkeypatch):
    """Buckets beyond LARGE go through blocks; small limits make a small group take that way."""
    monkeypatch.setattr(near, "LARGE", 3)
    monkeypatch.setattr(near, "BLOCK", 8)
    rng = random.Random(6)
    base = [f"w{i}" for i in range(150)]
    texts = [noisy(rng, base, rng.choice([0, 1, 3, 5, 6, 8])) for _ in range(70)] + [noisy(rng, base, 3) + " tail tail tail" for _ in range(10)]
    got = {r["doc_id"]: r["class_id"] for r in near.classes(docs(spark, texts)).collect()}
    assert got == truth(texts)


def test_small_buckets_inside_clusters_lose_no_link(spark):
    """10 and 30 share a small bucket only, and neither is open in the large buckets that one cluster holds."""

    def edited(words, at, n, name):
        return words[:at] + [f"{name}{k}" for k in range(n)] + words[at + n :]

    base = [f"w{k}" for k in range(200)]
    thirty = edited(base, 0, 15, "c")
    texts = {10: base, 1: edited(base, 185, 15, "a"), 30: thirty, 2: edited(thirty, 100, 12, "b"), 20: [f"z{k}" for k in range(200)]}
    in_x, in_y = range(100, 100 + near.LARGE), range(300, 300 + near.LARGE)
    texts |= {k: [*texts[1], f"e{k}"] for k in in_x} | {k: [*texts[2], f"e{k}"] for k in in_y}
    buckets = {7: [1, 10, 20, *in_x], 8: [2, 20, 30, *in_y], 9: [1, 10, 30]}
    reps = spark.createDataFrame([(k, [b for b, m in buckets.items() if k in m]) for k in texts], "rep long, bands array<long>")
    labels = {r["id"]: r["label"] for r in near.links(spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string"), reps).collect()}
    assert jp(set_of(" ".join(base)), set_of(" ".join(thirty))) >= near.LEAST > jp(set_of(" ".join(texts[1])), set_of(" ".join(thirty)))
    assert labels == {k: 1 for k in texts if k != 20}


def test_block_links_by_brute_force():
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    texts = [noisy(rng, base, rng.choice([0, 1, 2, 3])) + rng.choice(["", " tail" * 9]) for _ in range(24)]
    g, w, at, _ = near.shingles(pa.array(texts))
    got = set(near.block_links(g, w, at, np.arange(0, 10), np.arange(10, 24)))
    sets = [set_of(t) for t in texts]
    assert got == {(i, j) for i in range(10) for j in range(10, 24) if jp(sets[i], sets[j]) >= 0.8 - 1e-9}


def test_rows_that_repeat_an_id(spark):
    """They are one document of their smallest text, and one row of them is kept at most."""
    a, b, c = "one two three four five six seven", "eight nine ten eleven twelve thirteen", "an other text of seven words here"
    rows = [(1, a, 1), (1, a, 2), (2, a, 3), (3, b, 4), (3, c, 5), (4, b, 6), (5, None, 7), (5, None, 8), (None, a, 9), (None, a, 10), (6, a, 11), (6, None, 12)]
    d = spark.createDataFrame(rows, "doc_id long, text string, gone int").select("doc_id", "text", "gone", F.lit(1).alias("n"), F.lit(2).alias("_gone"))
    got = sorted(((r["doc_id"], r["class_id"], r["kept"]) for r in near.classes(d).collect()), key=str)
    want = [(1, 1, True), (1, 1, False), (2, 1, False), (3, 3, True), (3, 3, False), (4, 4, True), (5, 5, True), (5, 5, False), (None, None, True), (None, None, True), (6, 1, False), (6, 1, False)]
    # 3 has the smaller of its two texts, c, so that 4 is alone with b
    assert got == sorted(want, key=str)
    kept = near.deduplicate(d)
    assert kept.columns == d.columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in kept.collect()) == [("1", a), ("3", c), ("4", b), ("5", ""), ("None", a), ("None", a)]


def test_deduplicate_keeps_columns(spark):
    d = docs(spark, ["a b c d e f g", "a b c d e f g", None, None])
    out = near.deduplicate(d)
    assert out.columns == d.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3]


# --- pieces ----------------------------------------------------------------------------------------------------------


def all_segmentations(own, word):
    edges, out = own.edges(word), []

    def walk(i, score, path):
        if i == len(word):
            out.append((score, tuple(path)))
            return
        for e, s, p in edges[i]:
            walk(e, score + s, [*path, p])

    walk(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


def test_nbest_by_brute_force():
    own = pieces.lattice(pieces.load(MODEL))
    for text in ("Hello wo", "thst is", "ab c d", "éç é", "er\nxq", "日本", "a▁b"):
        ids, best, swaps = own.encode(pa.array([text]), 4)
        want = heapq.nlargest(4, all_segmentations(own, (" " + text).encode()))
        assert np.allclose(best.to_pylist()[0], [s for s, _ in want])
        assert len(swaps.to_pylist()[0]) == len(want) and swaps.to_pylist()[0][0] == []
        if len(want) < 2 or want[0][0] != want[1][0]:
            assert tuple(ids.to_pylist()[0]) == want[0][1]


def test_swaps_give_their_scores():
    model = pieces.load(MODEL)
    own = pieces.lattice(model)
    text = "there were seven thistles"
    ids, best, swaps = own.encode(pa.array([text]), 4)
    cut = [(" " + w).encode() for w in text.split()]
    score = {i: s for i, s in enumerate(model[1])}
    for total, swap in zip(best.to_pylist()[0], swaps.to_pylist()[0], strict=True):
        chosen = {s["segment"]: s["ids"] for s in swap}
        assert total == pytest.approx(sum(score[p] for k, w in enumerate(cut) for p in (chosen.get(k) or own.nbest(w, 1)[0][1])))


def test_packed_tries_hold_their_transitions():
    rng = np.random.default_rng(4)
    keys = np.unique(rng.integers(1, 400, 3000) * 50 + rng.integers(1, 50, 3000))
    child = rng.integers(1, 1000, len(keys)).astype(np.int32)
    base, owner, to = pieces.packed(keys, child, 401, 50)
    want = dict(zip(keys.tolist(), child.tolist(), strict=True))
    for node in range(401):
        at = base[node] + np.arange(50)
        got = np.where(owner[at] == node, to[at], 0)
        assert got.tolist() == [want.get(node * 50 + c, 0) for c in range(50)]


def test_round_trip(spark):
    texts = [*ODD, "▁ ▁", "tab\tand\r\nline", "  two  spaces ", "\x00\x01", "é" * 5000]
    coded = pieces.encode(docs(spark, texts), MODEL, check=True)
    back = {r["doc_id"]: r for r in pieces.decode(coded, MODEL).collect()}
    for i, t in enumerate(texts):
        assert back[i]["decoded"] == t and back[i]["round_trip"]
    assert back[0]["ids"] is None and back[1]["ids"] == []
    assert pieces.encode(docs(spark, []).limit(0), MODEL).count() == 0


# --- licences --------------------------------------------------------------------------------------------------------


def test_licences_by_brute_force(spark):
    rng = random.Random(7)
    own = licences.Templates(licences.TEMPLATES)
    texts = list(ODD)
    for _ in range(60):
        words = licences.TEMPLATES[rng.choice(own.names)].split()
        for _ in range(len(words) // 30):
            words[rng.randrange(len(words))] = "zzz"
        fill = lambda: [f"f{rng.randrange(999)}" for _ in range(rng.randrange(200))]
        texts.append(" ".join(fill() + words + fill()))
    got = {r["doc_id"]: {m["name"] for m in r["licences"]} for r in licences.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        h, rows = licences.word_hashes(pa.array([t], pa.string()))
        for k, name in enumerate(own.names):
            size = min(5, len(licences.TEMPLATES[name].split()))
            g, _ = ragged.grams(h, rows, size)
            n = len(own.sets[k])
            whole = any(len(set(g[a : a + n].tolist()) & set(own.sets[k].tolist())) >= 0.8 * n for a in range(max(0, len(g) - n + 1)))
            assert not whole or name in got[i], (name, t[:80])
            if name in got[i]:
                assert np.isin(own.sets[k], g).mean() >= 0.8 - 1e-12


def test_licence_spans(spark):
    text = "some words. " + licences.TEMPLATES["mit-short"] + " more words"
    (m,) = licences.scan(docs(spark, [text])).first()["licences"]
    assert (m["name"], m["start"], m["end"], m["containment"]) == ("mit-short", 2, 7, 1.0)


def test_licences_held_several_times(spark):
    """A notice twice side by side, far apart, edited, and often: a match each."""
    short, mit, bsd = licences.TEMPLATES["mit-short"], licences.TEMPLATES["mit"], licences.TEMPLATES["bsd"]
    fill = " ".join(f"f{k}" for k in range(700))
    edited = mit.split()
    edited[40] = "zzz"
    texts = [f"{mit} {mit}", f"{bsd} {fill} {bsd}", f"x {short} y {short} {short}", f"{' '.join(edited)} {fill} {mit} end", " ".join([bsd] * 30), f"{short} {fill} {mit}"]
    texts.append(" ".join([*edited, *mit.replace("Software.", "zzz", 1).split()]))
    got = {r["doc_id"]: [(m["name"], m["start"], m["end"], m["containment"]) for m in r["licences"]] for r in licences.scan(docs(spark, texts)).collect()}
    (n, k, b), rows = [len(licences.word_hashes(pa.array([x]))[0]) for x in (mit, short, bsd)], range(30)
    assert got[0] == [("mit", 0, n, 1.0), ("mit", n, 2 * n, 1.0)]
    assert got[1] == [("bsd", 0, b, 1.0), ("bsd", b + 700, 2 * b + 700, 1.0)]
    assert got[2] == [("mit-short", 1, 1 + k, 1.0), ("mit-short", 2 + k, 2 + 2 * k, 1.0), ("mit-short", 2 + 2 * k, 2 + 3 * k, 1.0)]
    assert [m[:3] for m in got[3]] == [("mit", 0, n), ("mit", n + 700, 2 * n + 700)] and 0.8 <= got[3][0][3] < got[3][1][3] == 1.0
    assert got[4] == [("bsd", i * b, (i + 1) * b, 1.0) for i in rows]
    assert got[5] == [("mit", 700 + k, 700 + k + n, 1.0), ("mit-short", 0, k, 1.0)]
    assert [m[:3] for m in got[6]] == [("mit", 0, n), ("mit", n, 2 * n)] and all(0.8 <= m[3] < 1 for m in got[6])


# --- mixing ----------------------------------------------------------------------------------------------------------


def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 500)
    q = np.rint(p * 1000).astype(int)
    n = rng.integers(10, 500, 500)
    df = spark.createDataFrame([(int(n[i]), [int(v) for v in q[i]]) for i in range(500)], "n_tokens long, posterior array<short>")
    weights = [0.5, 0.3, 0.2]
    steps, targets = mixing.fit_rates(df, weights, None)
    r = np.array([x["r"] for x in df.select(mixing.rate(F.col("posterior"), steps, None).alias("r")).collect()])
    got = (q / 1000 * (n * r)[:, None]).sum(0)
    assert np.abs(got / targets - 1).max() < 0.02 and r.min() >= 0
    # the same descent in numpy
    y = last = np.ones(500)
    m = (q.T / 1000 * n) @ (q / 1000)
    for t in range(len(steps)):
        res = targets - (q / 1000 * (n * y)[:, None]).sum(0)
        new = np.maximum(y + q / 1000 @ res / np.linalg.eigvalsh(m)[-1], 0)
        y, last = new + (new - last) * t / (t + 3), new
    assert np.abs(last - r).max() < 1e-6


@pytest.mark.parametrize(("gap", "weights", "limit"), [(2, [0.9, 0.07, 0.03], None), (5, [0.9, 0.07, 0.03], None), (4, [0.985, 0.01, 0.005], 1.0)])
def test_soft_posteriors_and_a_rare_domain(spark, gap, weights, limit):
    """Reachable targets are met; unreachable ones as nearly as by a long descent."""
    rng = np.random.default_rng(5)
    label = rng.choice(3, 4000, p=[0.8, 0.15, 0.05])
    z = rng.normal(size=(4000, 3))
    z[np.arange(4000), label] += gap
    q = np.rint(np.exp(z) / np.exp(z).sum(1, keepdims=True) * 1000).astype(int)
    n = rng.integers(10, 500, 4000)
    df = spark.createDataFrame([(int(n[i]), [int(v) for v in q[i]]) for i in range(4000)], "n_tokens long, posterior array<short>")
    steps, targets = mixing.fit_rates(df, weights, limit)
    r = np.array([x["r"] for x in df.select(mixing.rate(F.col("posterior"), steps, limit).alias("r")).collect()])
    assert r.min() >= 0 and r.max() <= (limit or np.inf)
    got = (q / 1000 * (n * r)[:, None]).sum(0)
    y = last = np.ones(4000)
    m = (q.T / 1000 * n) @ (q / 1000)
    for t in range(3000):
        res = targets - (q / 1000 * (n * y)[:, None]).sum(0)
        new = np.clip(y + q / 1000 @ res / np.linalg.eigvalsh(m)[-1], 0, limit)
        y, last = new + (new - last) * t / (t + 3), new
    best = np.linalg.norm(targets - (q / 1000 * (n * last)[:, None]).sum(0))
    if limit is None:
        assert np.abs(got / targets - 1).max() < 1e-3
    else:
        assert best > 0.1 * n.sum() and np.linalg.norm(targets - got) <= best * (1 + 1e-6)


def test_posteriors_sum_to_one():
    rng = np.random.default_rng(1)
    p = np.concatenate([rng.dirichlet([0.2] * 4, 300), [[0.25] * 4, [1, 0, 0, 0], [1 / 3, 1 / 3, 1 / 3, 0]]])
    q = mixing.thousandths(p)
    assert (q.sum(1) == 1000).all() and np.abs(q / 1000 - p).max() < 1e-3 and q.min() >= 0
    assert q[-1].tolist() == [334, 333, 333, 0]


def test_targets_are_met_on_the_sample_tables(spark):
    """Rates on real posteriors: totals within a thousandth of their targets, and as near to 1 as an exact solution's."""
    sf = "/root/testdata/sf0.01"
    got = queries.op4_mixing(spark, sf).toPandas()
    p, n, r = np.stack(got["posterior"]) / 1000, got["n_tokens"].to_numpy(float), got["rate"].to_numpy()
    targets = np.array(queries.TARGETS) * n.sum()
    total = (p * (n * r)[:, None]).sum(0)
    assert np.abs(total / targets - 1).max() <= 1.01 * mixing.TOLERANCE
    # nonnegative least squares, by an active set: its residual is 0 here, so the targets are reachable
    free = np.ones(len(n), bool)
    for _ in range(100):
        a = (p[free] * n[free][:, None]).T
        x = 1 + (p[free] @ np.linalg.lstsq(a @ p[free], targets - a.sum(1), rcond=None)[0])
        if (x >= -1e-9).all():
            break
        free[np.flatnonzero(free)[x < 0]] = False
    assert np.allclose((p[free] * (n[free] * x)[:, None]).sum(0), targets)
    assert (n[free] * (x - 1) ** 2).sum() + n[~free].sum() >= 0.99 * (n * (r - 1) ** 2).sum()


def test_domains_are_learned_from_telling_words():
    """Rare words that are present tell the domains of long texts, of more than two as well."""
    rng = random.Random(3)
    text = lambda v: " ".join([f"w{rng.randrange(900)}" for _ in range(300)] + [["", "Awful!", "shoddy"][v]])
    y = [i % 3 for i in range(450)]
    rows = list(linear.sparse_rows(*ragged.buffer_of(pa.array([text(v) for v in y])), linear.FEW))
    table = pa.table({"label": pa.array(y, pa.int32()), "index": [i for i, _ in rows], "value": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    model = linear.fit(table, 3, linear.FEW)
    p = model.probabilities(*ragged.buffer_of(pa.array([text(v) for v in y])))
    assert (p.argmax(1) == np.array(y)).mean() > 0.97


def test_descent_finds_the_minimum():
    rng = np.random.default_rng(7)
    a = rng.normal(size=(30, 12))
    b = rng.normal(size=30)
    x = linear.descend(lambda x: (0.5 * ((a @ x - b) ** 2).sum(), a.T @ (a @ x - b)), np.zeros(12), 200)
    assert np.allclose(x, np.linalg.lstsq(a, b, rcond=None)[0], atol=1e-3)
    assert linear.descend(lambda x: (0.0, 0 * x), np.ones(2), 5).tolist() == [1, 1]


def test_verdicts_by_a_plain_version(spark):
    """The classifier's probability from its own weights, word by word and triple by triple."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    model = quality.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    got = {r["doc_id"]: r for r in quality.assess(d.select("doc_id", "text"), model).collect()}
    for r in d.limit(40).collect():
        data, offs = ragged.buffer_of(pa.array([r["text"]]))
        z = model.bias.astype(float).copy()
        w = re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())
        h = [int(ragged.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0]) for x in w]
        cp = [ord(c) + 1 for c in r["text"] or ""]
        for k, kind in enumerate(model.kinds):
            seq, n = (h, int(kind[1])) if kind[0] == "w" else (cp, int(kind[1]))
            runs = [seq[i : i + n] for i in range(len(seq) - n + 1)]
            m = 1 << 64
            fold = lambda run: sum(v * ragged._MULT ** (n - 1 - i) for i, v in enumerate(run)) % m  # noqa: B023, E731
            keys = [v if kind == "w1" else int(ragged.mix(np.array([fold(run)], np.uint64))[0]) for run in runs for v in run[:1]]
            if keys:
                z += np.mean([model.weights[(g >> 40) % linear.BUCKETS + k * linear.BUCKETS] for g in keys], 0, dtype=float)
        p = linear.softmax((z * model.scale + model.shift)[None])[0, 1]
        assert got[r["doc_id"]]["quality"] == pytest.approx(p, abs=1e-5)
        assert got[r["doc_id"]]["kept"] == (not got[r["doc_id"]]["base_failed"] and got[r["doc_id"]]["quality"] >= 0.5)


def test_mix_of_odd_rows(spark):
    labels = spark.createDataFrame([(3, 0), (5, 1)], "doc_id long, label int")
    out = mixing.mix(docs(spark, ODD), labels, [0.5, 0.5]).collect()
    assert len(out) == len(ODD) and all(r["rate"] >= 0 and r["n_copies"] >= 0 for r in out)
    by = {r["doc_id"]: r for r in out}
    assert by[5]["rate"] == by[6]["rate"] and by[0]["n_tokens"] == 0
    assert mixing.mix(docs(spark, []).limit(0), labels, [0.5, 0.5]).count() == 0
    assert mixing.mix(docs(spark, ODD), labels.limit(0), [1, 1], limit=1.0).filter("rate > 1").count() == 0


def test_limits_keep_clean_rows(spark):
    df = spark.createDataFrame([(100, [1000, 0])] * 5 + [(100, [0, 1000])] * 5, "n_tokens long, posterior array<short>")
    steps, _ = mixing.fit_rates(df, [0.9, 0.1], 1.0)
    r = [x["r"] for x in df.select(mixing.rate(F.col("posterior"), steps, 1.0).alias("r")).collect()]
    assert r[:5] == [1.0] * 5 and r[5] == pytest.approx(0.2, abs=0.02)
