"""Training-data operators against brute force, and their treatment of odd rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.llm import common, decontaminate, jaccard, knn, pieces, pii, quality, secrets, tokenfile, toxicity, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def text(r, n):
    return " ".join(r.choice(WORDS, n))


def frame(spark, rows, extra=True):
    """Documents with columns whose names clash with those that operators use inside."""
    cols = "doc_id long, text string" + ", d string, _d long, n long, token string, spans string, lang string, source string, n_chars long" * extra
    full = [(*r, "x", 7, 3, "t", "s", "en", f"s{(r[0] or 0) % 3}", len(r[1] or "")) if extra else r for r in rows]
    return spark.createDataFrame(full, cols)


ODD = [(None, "alpha beta"), (900, None), (901, ""), (902, " \n\t "), (903, "É" * 3), (904, "x" * 50_000), (905, "alpha beta"), (905, "alpha beta")]


@pytest.fixture(scope="module")
def docs():
    r = np.random.default_rng(5)
    rows = [(int(i), text(r, int(r.integers(1, 60)))) for i in range(60)]
    base = text(r, 120)
    for k in range(12):  # near copies
        w = base.split()
        w[int(r.integers(0, 120))] = f"edit{k}"
        rows.append((100 + k, " ".join(w)))
    rows += [(200 + k, rows[3][1]) for k in range(5)]
    return rows + ODD


# --- decontamination -----------------------------------------------------------------


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute_hits(t, items, n=10):
    w, hit, found = words(t), set(), set()
    for i, x in items:
        v = words(x)
        size = min(n, len(v))
        wins = {tuple(v[s : s + size]) for s in range(len(v) - size + 1)} if v else set()
        for s in range(len(w) - size + 1):
            if size and tuple(w[s : s + size]) in wins:
                hit |= set(range(s, s + size))
                if i is not None:
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


@pytest.mark.parametrize("bound", [0, 100_000])
def test_decontamination_matches_brute_force(spark, docs, bound):
    items = [(1, " ".join(docs[4][1].split()[:12])), (2, docs[70][1]), (10, "Alpha, BETA"), (3, ""), (4, None), (None, docs[72][1]), (2, docs[70][1]), (5, "never seen words at all")]
    out = decontaminate.find_contamination(frame(spark, docs), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, words int"), bound=bound)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_hit, list(r["items"])) for r in out.collect())
    assert got == sorted((i if i is not None else -1, *brute_hits(t, items)) for i, t in docs)


def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    out = decontaminate.find_contamination(frame(spark, ODD), none).collect()
    assert len(out) == len(ODD) and not any(r.n_hit for r in out)
    assert decontaminate.find_contamination(frame(spark, ODD).limit(0), none).count() == 0
    kept = decontaminate.drop_contaminated(frame(spark, ODD), spark.createDataFrame([(1, "alpha beta")], "item_id long, text string"))
    assert kept.columns == frame(spark, ODD).columns and sorted(r.doc_id for r in kept.collect()) == [900, 901, 902, 903, 904]


def test_proximity(spark):
    rows = [(1, "one x x two x x x x x x x x x x x three two one"), (2, "two one"), (3, "one one")]
    got = decontaminate.find_proximity(frame(spark, rows), spark.createDataFrame([(7, "one two three")], "item_id long, text string"), within=3).collect()
    assert [(r.doc_id, r.item_id, r.pos) for r in got] == [(1, 7, 15)]
    assert {r.doc_id for r in decontaminate.find_proximity(frame(spark, rows), spark.createDataFrame([(7, "one two")], "item_id long, text string"), within=3).collect()} == {1, 2}


# --- nearest neighbours ------------------------------------------------------------------


@pytest.mark.parametrize("scale,block", [(1.0, 50), (1e5, 1000)])
def test_knn_matches_brute_force(spark, scale, block):
    r = np.random.default_rng(2)
    x = (r.normal(size=(150, 8)) + r.integers(0, 3, 150)[:, None]) * scale
    rows = [(int(i), [float(v) for v in x[i]], "z") for i in range(150)]
    rows += [(300, None, "z"), (400, [float("nan")] * 8, "z"), (401, [1.0, None] + [0.0] * 6, "z"), (None, [1.0] * 8, "z"), (500, [], "z"), (7, rows[7][1], "z"), (600, rows[7][1], "z"), (601, rows[7][1], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string")
    got = {(q.query_id, q.rank): (q.vec_id, q.score) for q in knn.knn_join(df, F.col("id") % 50 == 0, k=4, block_rows=block, n_pivots=6).collect()}
    ints = {i: [int(np.floor(1024 * v)) for v in e] + [0] * (8 - len(e)) for i, e, _ in rows if i is not None and e is not None and all(v is not None and np.isfinite(v) for v in e)}
    want = {}
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q)[:4]
        want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want


def test_knn_of_few(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in knn.knn_join(df, F.col("id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert knn.knn_join(df.limit(0), F.col("id") == 0).count() == 0 == knn.knn_join(df, F.col("id") == 9).count()


# --- pieces -----------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def segmenter():
    with open(pieces.model_path(), "rb") as f:
        return pieces.Segmenter(f.read())


def every_segmentation(seg, t):
    out = []

    def go(end, score, ids):
        if end == 0:
            out.append((score, ids))
        for b, own, s in seg.edges(t, end) if end else ():
            go(b, score + s, own + ids)

    go(len(t), 0, ())
    return sorted(out, key=lambda x: -x[0])


def test_nbest_matches_enumeration(segmenter):
    r = np.random.default_rng(1)
    for _ in range(60):
        t = "".join(r.choice(list("then ou é\nሴ "), int(r.integers(1, 10))))
        want = every_segmentation(segmenter, "▁" + t.replace(" ", "▁"))
        got = segmenter.encode([t], 5)[0]
        assert [s for s, _ in got] == [s for s, _ in want[:5]]
        assert len({tuple(i) for _, i in got}) == len(got) and {(s, tuple(map(int, i))) for s, i in got} <= set(want)
        assert all(segmenter.decode(i.tolist()) == t for _, i in got)


def test_pieces_operator(spark, docs):
    enc = pieces.encode(frame(spark, docs), pieces.model_path(), n=3)
    rows = enc.collect()
    assert len(rows) == len(docs)
    back = pieces.decode(enc, pieces.model_path()).collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t in docs)
    assert all(r.scores == sorted(r.scores, reverse=True) and len(r.others) == len(r.scores) - 1 for r in rows)
    check = pieces.encode_and_check(frame(spark, docs), pieces.model_path()).collect()
    assert all(r.round_trip for r in check) and {r.n_pieces for r in check if r.doc_id in (900, 901)} == {0}


def test_cache_overflow_changes_nothing(segmenter, monkeypatch):
    texts = [f"w{k} theta iota{k}" for k in range(40)]
    want = [x[0][0] for x in segmenter.encode(texts)]
    monkeypatch.setattr(pieces, "CACHE", 10)
    segmenter._clear()
    assert [x[0][0] for t in texts for x in segmenter.encode([t])] == want
    segmenter._clear()


# --- token files ----------------------------------------------------------------------------------


def test_token_codec_round_trip():
    r = np.random.default_rng(3)
    cases = [[], [np.array([], np.uint16)], [np.array([1], np.uint16)], [np.full(7000, 5, np.uint16), np.array([], np.uint16), np.array([65535], np.uint16)], [r.integers(0, 65536, 5000).astype(np.uint16)], [(r.zipf(1.3, 9000) % 5000).astype(np.uint16) for _ in range(3)]]
    for c in cases:
        data = tokenfile.pack_file([None, *range(1, len(c))][: len(c)], c)
        names, back = tokenfile.unpack_file(data)
        assert names == [None, *range(1, len(c))][: len(c)] and len(back) == len(c) and all(np.array_equal(x, y) for x, y in zip(back, c))
    spoiled = bytearray(data)
    spoiled[-200] ^= 1
    with pytest.raises((ValueError, IndexError)):
        tokenfile.unpack_file(bytes(spoiled))


def test_repetition_compresses():
    one = np.tile(np.arange(50, dtype=np.uint16), 400)
    assert len(tokenfile.pack_file([1], [one])) < one.nbytes / 8


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    more = [(300, "It's DON'T 'll x's 42 <|endoftext|> a\x1cb ½ Σας Ünï—ok z İstanbul é"), (301, "Straße ŉ ſ")]
    m = tokenfile.write_tokens(frame(spark, docs + more), f"{common.shared_dir(spark)}/tokens-test", path, file_chars=4000)
    assert m.count() > 1
    tok = Tokenizer.from_file(path)
    want, at = [], 0
    for i, ids in sorted(((i if i is not None else -1, tok.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in docs + more), key=lambda x: (x[0], b"".join(v.to_bytes(2, "little") for v in x[1]))):
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = tokenfile.read_tokens(m, common.shared_dir(spark)).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in got)
    empty = tokenfile.write_tokens(frame(spark, docs).limit(0), f"{common.shared_dir(spark)}/tokens-none", path)
    assert tokenfile.read_tokens(empty, common.shared_dir(spark)).count() == 0


# --- Jaccard join -------------------------------------------------------------------------------------


def shingles(t, k):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k, percent):
    ids = [i for i, _ in rows if i is not None]
    sets = {i: shingles(t, k) for i, t in rows if i is not None}
    low = {i: i for i in ids}

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and sets[b]:
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("k,percent", [(4, 85), (5, 80), (1, 60)])
def test_jaccard_matches_brute_force(spark, docs, k, percent, monkeypatch):
    r = np.random.default_rng(9)
    chain = text(r, 80).split()
    more = []
    for s in range(15):  # each like its neighbours, ends unlike
        chain = [*chain[3:], *(f"c{s}{j}" for j in range(3))]
        more.append((400 + s, " ".join(chain)))
    shared = text(r, 30)
    more += [(500 + s, f"{text(r, 25)} {shared} {text(r, 20)}") for s in range(30)]
    rows = docs + more
    monkeypatch.setattr(jaccard, "HOT_DOCS", 3)
    got = jaccard.jaccard_classes(frame(spark, rows), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert len(got) == len(rows)
    assert all(x.component_id == want.get(x.doc_id) for x in got)
    size = defaultdict(set)
    for i, t in rows:
        size[i].add(len(shingles(t, k)))
    assert all(x.n_shingles in size[x.doc_id] for x in got)


def test_keep_one(spark, docs):
    kept = jaccard.keep_one(frame(spark, docs))
    want = brute_components(docs, 5, 80)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == frame(spark, docs).columns and sorted(i for i in ids if i is not None) == sorted({i for i in want if want[i] == i}) and ids.count(None) == 1
    assert jaccard.jaccard_classes(frame(spark, docs).limit(0)).count() == 0


def test_shuffled_joins_give_the_same(spark, docs, monkeypatch):
    want = {(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(frame(spark, docs)).collect()}
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "SHARED_ROWS", 0)
    assert {(r.doc_id, r.component_id) for r in jaccard.jaccard_classes(frame(spark, docs)).collect()} == want


def test_components_of_a_long_path(spark):
    e = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 102), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(e, "test").collect()}
    assert all(got[k] == 0 for k in range(61)) and got[100] == got[102] == 100


def test_keep_one_judges_each_text_of_a_repeated_id(spark):
    r = np.random.default_rng(12)
    a, b, c, e = (text(r, 80) for _ in range(4))
    rows = [(1, a), (1, b), (1, a), (2, a + " more"), (7, b), (7, c), (8, e), (8, e), (9, ""), (9, None), (None, a)]
    kept = [(x.doc_id, x.text) for x in jaccard.keep_one(frame(spark, rows)).collect()]
    assert sorted(t for i, t in kept if i is not None and t) == sorted([next(t for i, t in kept if t in (a, a + " more") and i), b, c, e])
    assert sorted((i, t) for i, t in kept if i == 8) == [(8, e)] and (None, a) in kept and (9, "") in kept and (9, None) in kept and (7, c) in kept


# --- toxicity -----------------------------------------------------------------------------------------


def toxic_corpus():
    r = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        sents = [text(r, int(r.integers(3, 9))) for _ in range(int(r.integers(1, 8)))]
        if bad:
            sents[int(r.integers(0, len(sents)))] += " grobian"
        rows.append((i, ". ".join(sents) + "."))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity_learns_from_bags_and_locates(spark):
    rows, labels = toxic_corpus()
    d = frame(spark, rows + ODD)
    lab = spark.createDataFrame([(i, 1, y) for i, y in labels] + [(None, 1, 1), (5, None, None), (99999, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(d, lab)
    got = {r.doc_id: r.score for r in toxicity.score(d, model).collect()}
    held = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([(got[i] >= 0.5) == bool(y) for i, y in held]) > 0.97
    assert got[900] == got[901] == got[902] == 0.0 and len(got) == len({i for i, _ in rows + ODD})
    spots = toxicity.offending(d, model).collect()
    assert spots and all("grobian" in s.sentence for s in spots)
    texts = dict(rows)
    assert all(texts[s.doc_id][s.start : s.end] == s.sentence for s in spots)
    kept = toxicity.filter_toxic(d, lab)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} >= {900, 901, None}


def test_one_huge_text_leaves_the_rest_to_learn_from(spark):
    rows, labels = toxic_corpus()
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    first = lab.filter(~toxicity.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    d = frame(spark, [(i, "x" * 300_000 if i == first else t) for i, t in rows])
    assert toxicity.fit(d, lab, fit_chars=250_000)["words"]["grobian"] > 1
    with pytest.raises(ValueError, match="toxic = 1"):
        toxicity.fit(frame(spark, [(i, t + "x" * 300_000 * (y and i < 40)) for (i, t), (_, y) in zip(rows, labels) if not y or i < 40]), lab, fit_chars=250_000)


def test_toxicity_without_labels(spark):
    d = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score < 0.5 for r in toxicity.score(d, toxicity.fit(d, none)).collect())


def test_held_out_rule(spark):
    got = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "i long").select("i", toxicity.held_out(F.col("i")).alias("h")).collect()
    assert all(r.h == (r.i is not None and zlib.crc32(str(r.i).encode()) % 5 == 0) for r in got)


# --- personal data ---------------------------------------------------------------------------------------


def naive_base(t):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)
    out += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15]


def test_base_patterns_match_plain_search():
    r = np.random.default_rng(8)
    parts = ["a.b", "@", "x", ".", "com", " ", "12", "4111111111111111", "4111 1111 1111 1111", "+1", "(555)", "-", "999", "1.2.3.4", "256.1.1.1", "é", "+", "\n", "0", "001.2.3.4"]
    for _ in range(3000):
        t = "".join(r.choice(parts, int(r.integers(1, 14))))
        assert pii.base_spans(t) == naive_base(t), t


@pytest.fixture(scope="module")
def field():
    return pii.train(pii.labelled_table())


def test_field_is_accurate_on_unseen_rows(field):
    assert field.plain_is_outside()
    table = pii.labelled_table(150, seed=99)
    got = field.viterbi([[pii.shape(w) for w in words] for words, _ in table])
    pairs = [(a, pii.LABELS[b]) for (_, labels), path in zip(table, got) for a, b in zip(labels, path)]
    assert np.mean([a == b for a, b in pairs]) > 0.98


def test_viterbi_is_the_best_path(field):
    import itertools

    line = [pii.shape(w) for w in ("call", "(212)", "555-0187", "now")]
    e = field.emissions(line)
    score = lambda y: field.first[y[0]] + sum(e[t, k] for t, k in enumerate(y)) + sum(field.trans[a, b] for a, b in zip(y, y[1:]))
    best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
    assert tuple(field.viterbi([line, line[:2]])[0]) == best


def test_plain_lines_decode_to_outside(field):
    for n in (1, 2, 7, 60):
        assert not field.viterbi([[pii.PLAIN] * n])[0].any()


def test_pii_adds_and_redacts(spark, field):
    rows = [(1, "write joe (at) mail (dot) com or (212) 555-0187 now"), (2, "mail a.b@c.org, ip 10.0.0.1 and +1 (524) 555-7373"), (3, "plain 2024-01-02 text 3.14")]
    got = {r.doc_id: r for r in pii.scan_pii(frame(spark, rows + ODD), field).collect()}
    kinds = [s.kind for s in got[1].spans]
    assert not got[1].base and kinds == ["email", "phone"]
    assert [s.kind for s in got[2].base] == ["email", "ip", "phone"] and got[3].spans == [] and got[900].spans == []
    red = pii.redact(frame(spark, rows + ODD), field)
    by = {r.doc_id: r for r in red.collect()}
    assert by[2].text == "mail [EMAIL], ip [IP] and [PHONE]" and by[2].n_chars == len(by[2].text) and by[900].text is None and red.columns == frame(spark, rows).columns
    assert by[3].text == rows[2][1]


# --- quality --------------------------------------------------------------------------------------------


def test_kneser_ney_sums_to_one_and_prefers_what_it_saw():
    r = np.random.default_rng(0)
    table = quality.class_table()
    code, n = quality._codes(["the cat sat", "", "on the mat\0x"], table)
    assert n.tolist() == [11, 0, 12] and len(code) == 23
    counts = np.bincount(quality._codes([text(r, 4000)], table)[0], minlength=32**4).reshape((32,) * 4)
    lp = quality.kneser_ney(counts)
    assert np.allclose(np.exp(lp).sum(-1), 1)
    flat = lp.ravel()
    seen, odd = (flat[quality._codes([t], table)[0]].mean() for t in ("alpha beta gamma", "xq%% zzj ##k"))
    assert seen > odd + 1




def test_quality_keeps_clean_text(spark):
    r = np.random.default_rng(6)
    rows = [(i, text(r, 60)) for i in range(120)] + [(200 + i, "".join(r.choice(list("zq#%xkj$ 0"), 200))) for i in range(10)]
    d = frame(spark, rows + ODD)
    out = {r.doc_id: r for r in quality.classify(d, spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(None,)], "doc_id long")).collect()}
    assert sum(out[i].keep for i in range(120)) >= 110 and not any(out[200 + i].keep for i in range(10))
    assert out[900].perplexity is None and not out[900].keep and out[0].threshold is not None
    none = quality.classify(d, spark.createDataFrame([], "doc_id long")).collect()
    assert len(none) == len(rows) + len(ODD) and all(r.keep == (r.perplexity is not None) for r in none)


def naive_pair_model(texts):
    """Log probability of a text by modified Kneser-Ney over word pairs, and (sum of p(b | a) over words, text end and unknown)."""
    pairs, after = Counter(), Counter()
    for t in texts:
        w = ["", *t.split(), "  "]
        pairs.update(zip(w, w[1:]))
    after.update(b for _, b in pairs)

    def cuts(c):
        k = [sum(x == r for x in c.values()) for r in (1, 2, 3, 4)]
        y = k[0] / (k[0] + 2 * k[1]) if k[0] + k[1] else 0
        d = [min(max(r - (r + 1) * y * k[r] / k[r - 1], 0.05), r) if k[r - 1] else 0.5 * r for r in (1, 2, 3)]
        return lambda x: d[min(x, 3) - 1] if x else 0

    cp, ca = cuts(pairs), cuts(after)
    rest = sum(map(ca, after.values())) / len(pairs) / (len(after) + 1)
    low = lambda b: (after[b] - ca(after[b])) / len(pairs) + rest

    def p(b, a):
        own = [n for (x, _), n in pairs.items() if x == a]
        return low(b) if not own else (pairs[a, b] - cp(pairs[a, b]) + sum(map(cp, own)) * low(b)) / sum(own)

    assert all(abs(sum(p(b, a) for b in [*after, "unknown"]) - 1) < 1e-9 for a in ("", "alpha", "nowhere"))

    def ppl(t):
        w = ["", *t.split(), "  "]
        return np.exp(-sum(np.log(p(b, a)) for a, b in zip(w, w[1:])) / (len(w) - 1))

    return ppl


def test_word_pair_scores_match_plain_kneser_ney(spark, monkeypatch):
    r = np.random.default_rng(8)
    made = [(n, int(r.integers(1, 3)), text(r, int(r.integers(1, 40)))) for n in ("en", "de") for _ in range(25)]
    rows = [(k, n, f, t) for k, (n, f, t) in enumerate((n, f, t) for n in ("en", "de") for f in (0, 1, 2, 3) for t in ("alpha beta gamma", "gamma beta alpha", "alpha strange word", "unheard", made[0][2]))]
    for shards, salts, block in ((4, 1, 2_000_000), (3, 2, 30)):
        monkeypatch.setattr(quality, "BLOCK_WORDS", block)
        table, languages = quality.train(spark.createDataFrame(made, "name string, fold int, text string"), shards)
        out = quality.score(spark.createDataFrame(rows, "row long, name string, fold int, text string"), table, languages, shards, salts)
        got = {x.row: x.perplexity for x in out.collect()}
        assert len(got) == len(rows) == out.count()
        for k, n, f, t in rows:
            assert got[k] == pytest.approx(naive_pair_model([x for m, g, x in made if m == n and g != (f or None)])(t), rel=1e-4)
    # All languages together, with the words and pairs that they share.
    pooled = spark.createDataFrame([(k, None, f, t) for k, _, f, t in rows[:20]], "row long, name string, fold int, text string")
    table, languages = quality.train(spark.createDataFrame(made, "name string, fold int, text string"), 3, True)
    for x in quality.score(pooled, table, languages, 3, 1, True).collect():
        want = naive_pair_model([x2 for _, g, x2 in made if g != (x.fold or None)])(rows[x.row][3])
        assert x.perplexity == pytest.approx(want, rel=1e-4)
    # The counts grow with the texts: three pairs each.
    once = lambda df: quality.train(df)[0].filter("kind = 2").agg(F.sum(F.get("values", F.lit(0)))).first()[0]
    more = spark.createDataFrame([("en", 1, f"word{k} other{k}") for k in range(500)], "name string, fold int, text string")
    assert once(more) == 2 * once(more.limit(250)) == 1500


def test_quality_of_empty_and_odd_tables(spark):
    columns, good = "doc_id long, text string, lang string", spark.createDataFrame([(3,), (4,), (5,)], "doc_id long")
    assert quality.classify(spark.createDataFrame([], columns), good).collect() == []
    rows = [(1, None, None), (2, "", "en"), (3, "a b c", "\0"), (4, "a b c", None), (5, "x" * 1_200_000 + " b c" * 10, "en"), (5, "a b", "en"), (6, "b", "fr")]
    out = quality.classify(spark.createDataFrame(rows, columns), good).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 4, 5, 5, 6]
    assert {r.doc_id for r in out if r.perplexity is None} == {1, 2} == {r.doc_id for r in out if not r.keep}
    # A language named like the mark of texts without one is scored as those are.
    assert len({r.perplexity for r in out if r.doc_id in (3, 4)}) == 1


def test_long_texts_and_other_characters_give_the_same_words():
    ids = quality._dictionary()
    for t in ("Ab c-9 é собака 日本 x\u0301y", "plain words, 12 and more", "\x1c\x85 \u3000z"):
        far = quality._words(t + " " * 1_000_000, ids)
        assert quality._words(t, ids).tolist() == far.tolist()
    assert [w for w in ids if w not in ("", "  ")] == ["ab", "c", "-", "9", "é", "собака", "日", "本", "x\u0301y", "plain", "words", ",", "12", "and", "more", "\x1c", "z"]
    near = "".join(c for c in map(chr, range(0x2100)) if not quality._OUTSIDE.search(c))
    assert len(near) > 1000 and quality._QUICK.findall(near) == quality._FULL.findall(near)
    x = [np.array([5, 2**63], np.uint64), np.zeros(0, np.uint32), np.array([-1, 7])]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(x, quality._unpack(quality._pack(*x)), strict=True))


def test_quality_sees_words_in_any_script_and_language(spark):
    """Classes of characters scored texts of another script, other digits and later languages alike."""
    r = np.random.default_rng(9)
    cyrillic = ["собака", "кошка", "дерево", "солнце", "вода", "земля"]
    rows = [(i, " ".join(r.choice(cyrillic, 40)), "ru") for i in range(60)] + [(100, " ".join(["".join(r.permutation(list(w))) + "ъщ" for w in r.choice(cyrillic, 40)]), "ru")]
    rows += [(200 + 2 * k + j, f"only{k} spoken{k} here{k} " * 5, f"l{k}") for k in range(70) for j in (0, 1)]
    rows += [(500, "eins zwei drei " * 9, None), (501, "only3 spoken3 here3", "none such")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = [(i,) for i in range(0, 60, 2)] + [(200 + 2 * k,) for k in range(70)]
    out = {x.doc_id: x for x in quality.classify(d, spark.createDataFrame(good, "doc_id long")).collect()}
    assert not out[100].keep and sum(out[i].keep for i in range(1, 60, 2)) >= 27
    assert len({round(out[201 + 2 * k].perplexity, 3) for k in range(70)}) == 1
    assert out[501].perplexity < out[500].perplexity


# --- secrets ----------------------------------------------------------------------------------------------


def naive_secrets(t):
    out = [(*m.span(), 0) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.ASCII) if len(m[1]) >= 12]
    out += [(*m.span(), 1) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(*m.span(), 2) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted((s, k, e) for s, e, k in out)


def test_secret_spans_match_plain_search(spark):
    r = np.random.default_rng(7)
    parts = ["token", "Password", "api_key", "APIKEY", "=", ": ", '"', "abcdef0123456789ab", "AKIA", "ABCDEFGH12345678", "é", " ", "secret", "x", "0123456789abcdef", "longvalue_12+/=", "\n", "€"]
    rows = [(i, "".join(r.choice(parts, int(r.integers(1, 14))))) for i in range(400)] + ODD
    got = secrets.scan_secrets(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    base = sorted((x.doc_id or -1, [(s.start, s.k, s.end) for s in x.spans if s.k < 3]) for x in got)
    assert base == sorted((i or -1, naive_secrets(t or "")) for i, t in rows)
    assert secrets.scan_secrets(frame(spark, rows).limit(0)).count() == 0


def test_ownership_separates_examples_from_live_values(spark):
    wide, own = "Zq8" + "aB3dE5gH7" * 3, "Yt9" + "kL2mN4pQ6" * 3
    rows = [(i, f"see {wide} here") for i in range(9)] + [(20, f"see {own} here"), (21, f"token = {wide}x")]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert got[3] == [] and [s.kind for s in got[20]] == ["bare"] and got[20][0].live
    assert [s.kind for s in got[21]] == ["assign"]


def test_wide_copies_inside_one_owner_are_examples(spark):
    wide, own = "Zq8" + "aB3dE5gH7" * 3, "Yt9" + "kL2mN4pQ6" * 3
    rows = [(3 * i, f"see {wide} here") for i in range(11)] + [(300, f"token = {wide}")] + [(3 * i, f"see {own} here") for i in range(200, 210)]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(frame(spark, rows)).collect()}
    assert got[3] == [] and [(s.kind, s.n_owners, s.n_repos, s.live) for s in got[300]] == [("assign", 1, 12, False)]
    assert [(s.kind, s.n_owners, s.n_repos, s.live) for s in got[600]] == [("bare", 1, 10, True)]


# --- archives ------------------------------------------------------------------------------------------------


def page_rows():
    fake = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 10\r\n\r\nHTTP/1.1 2\r\n\r\n"
    big = "<p>" + "é" * 3000
    return [(1, "u", "x" * 150), (2, "u ü", "x" * 150), (3, None, "short"), (4, "u", "short"), (5, "u", None), (6, "u", "a" + fake * 40 + "z"), (7, "u", big), (8, "u", big), (9, "u", fake), (0, "u", big)]


@pytest.mark.parametrize("file_bytes,range_bytes", [(1 << 20, 1 << 20), (4000, 700)])
def test_archives_round_trip(spark, file_bytes, range_bytes):
    rows = page_rows()
    p = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(1)
    folder = common.fresh_path(spark, "warc-test")
    m = warc.write_archives(p, folder, file_bytes=file_bytes)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(spark, m, folder, range_bytes).collect()}
    first = {}
    for i, _, h in sorted(rows):
        first.setdefault(h or "", i)
    want = {}
    for i, _, h in rows:
        b = (h or "").encode()
        copy = len(b) >= 100 and first[h or ""] != i
        want[i] = (len(b), hashlib.sha256(b).hexdigest(), "revisit" if copy else "response", first[h or ""] if copy else None)
    assert got == want


def test_archives_of_nothing_and_odd_ids(spark):
    p = spark.createDataFrame([], "page_id long, url string, html string")
    folder = common.fresh_path(spark, "warc-none")
    assert warc.read_archives(spark, warc.write_archives(p, folder), folder).count() == 0
    p = spark.createDataFrame([(None, "u", "y" * 120), (3, "u", "y" * 120), (3, "u", "y" * 120)], "page_id long, url string, html string")
    folder = common.fresh_path(spark, "warc-odd")
    got = sorted((r.page_id or -1, r.record_type) for r in warc.read_archives(spark, warc.write_archives(p, folder, bound=0), folder).collect())
    assert got == [(-1, "revisit"), (3, "response"), (3, "response")]


@pytest.mark.parametrize("range_bytes", [1 << 20, 700])
def test_archives_hold_pages_of_very_long_urls(spark, range_bytes):
    rows = [(1, "u", "a" * 50), (2, "é" * 9000, "b" * 500), (3, "x" * 70_000, "WARC/1.0\r\n" * 300), (4, "u", "b" * 500), (5, "u", "c")]
    folder = common.fresh_path(spark, "warc-long")
    m = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.read_archives(spark, m, folder, range_bytes).collect()}
    assert got == {i: (len(h), hashlib.sha256(h.encode()).hexdigest(), 2 if i == 4 else None) for i, _, h in rows}


def test_archives_that_lack_records_are_an_error(spark):
    folder = common.fresh_path(spark, "warc-short")
    m = warc.write_archives(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), folder)
    with pytest.raises(ValueError, match="2 of 3"):
        warc.read_archives(spark, m.withColumn("n", F.col("n") + 1), folder).count()


# --- personal data of odd sizes ---------------------------------------------------------------------------


def test_personal_data_of_very_long_runs_and_lines(field):
    import time

    zeros = "0" * 5000
    assert [x for x in pii.base_spans(f"at {zeros}1.2.3.4 and {zeros}256.1.1.1 x") if x[0] == 1] == [(1, 3, 3 + 5000 + 7)]
    assert pii.base_spans("1.2.3.4.5.6.7.8.9") == naive_base("1.2.3.4.5.6.7.8.9")
    start = time.time()
    assert pii.base_spans("7" * 1_000_000) == [] and pii.base_spans("1.1." * 250_000)[:1] == [(1, 0, 7)]
    assert pii.find_pii(["@" * 200_000 + " 1"], field) == [([], [])]
    line = " ".join(["word"] * 200_000 + ["call", "(212)", "555-0187", "now"])
    assert [x[0] for x in pii.find_pii([line, "x 1"], field)[0][1]] == [3]
    many = "write +1 (524) 555-7373 or (212) 555-0187 now " * 4000
    base, spans = pii.find_pii([many], field)[0]
    assert len(base) == 4000 and len(spans) >= 8000 - 1
    assert time.time() - start < 120


def test_batches_of_lines_decode_as_lines_alone(field, monkeypatch):
    r = np.random.default_rng(4)
    words = ["call", "(212)", "555-0187", "a@b", "10.0.0.1", "4111", "1111", "(at)", "x", "+1"]
    lines = [[pii.shape(w) for w in r.choice(words, int(r.integers(0, 30)))] for _ in range(60)]
    alone = [field.viterbi([x])[0].tolist() for x in lines]
    for size in (1, 40, 65_536):
        monkeypatch.setattr(pii, "BATCH_WORDS", size)
        assert [x.tolist() for x in field.viterbi(lines)] == alone


def test_redact_without_a_size_column(spark, field):
    d = spark.createDataFrame([(1, "mail a.b@c.org"), (2, None)], "doc_id long, text string")
    assert sorted(pii.redact(d, field).collect()) == [(1, "mail [EMAIL]"), (2, None)]


# --- what the nearest-neighbour join sends ------------------------------------------------------------------


@pytest.mark.parametrize("tight", [True, False])
def test_knn_sends_rows_where_they_may_count(spark, tight):
    """Far clusters get their own rows; where bounds say nothing, all groups share one copy of the table."""
    r = np.random.default_rng(12)
    centre = r.normal(size=(6, 16))
    x = centre[np.arange(600) % 6] * 40 + r.normal(size=(600, 16)) * 0.05 if tight else r.normal(size=(600, 16))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(600)], "vec_id long, embedding array<double>")
    asked, sent, _, _ = knn.route(df, F.col("id") % 10 < 2, 3, "vec_id", "embedding", 40 if tight else 8, 50_000, 10_000)
    n, groups = sent.count(), asked.select("g").distinct().count()
    assert (groups > 1 and n < groups * 600 / 3) if tight else (groups == 1 and n == 600)
    got = {}
    for q in knn.knn_join(df, F.col("id") % 10 < 2, k=3, n_pivots=40 if tight else 8, block_rows=130, block_queries=50).collect():
        got.setdefault(q.query_id, []).append((q.vec_id, q.score))
    v = np.floor(1024 * x).astype(np.int64)
    for q in (i for i in range(600) if i % 10 < 2):
        s = v @ v[q]
        assert sorted(got[q], key=lambda y: (-y[1], y[0])) == sorted(((i, int(s[i])) for i in range(600) if i != q), key=lambda y: (-y[1], y[0]))[:3]


def test_top_k_by_steps(monkeypatch):
    r = np.random.default_rng(13)
    x, ids = r.integers(-3, 4, (300, 4)), r.permutation(300)
    want = {q: sorted(((-int(x[a] @ x[b]), int(ids[b])) for b in range(300) if b != a))[:5] for a, q in enumerate(ids.tolist())}
    for rows, queries in ((16_384, 256), (7, 11), (3, 300)):
        monkeypatch.setattr(knn, "STEP_ROWS", rows)
        monkeypatch.setattr(knn, "STEP_QUERIES", queries)
        got = knn.top_k(ids, x, ids, x, 5, 3)
        for q, g in got.groupby("query_id"):
            assert sorted(zip(-g["score"], g["vec_id"])) == want[q]
        assert len(got) == 1500


# --- pre-tokens ---------------------------------------------------------------------------------------------


def test_encoder_matches_the_library(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    with open(path) as f:
        enc, tok = tokenfile.Encoder(f.read()), Tokenizer.from_file(path)
    r = np.random.default_rng(15)
    plain = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'", "a", "B", "é", "É", "Ÿ", "Ż", "ß", "1", "9", " ", "\n", "\t", "-", "!", "<", "it", "DON", "_", "e", "l"]
    odd = ["|", "×", "İ", "ŉ", "ſ", "中", "\0", "\x1c", "<|endoftext|>", "é", " ", "Σ"]
    for words in (plain, plain + odd):
        texts = ["".join(r.choice(words, int(r.integers(0, 15)))) for _ in range(1500)] + ["", "x" * 50_000, "'", "9" * 70]
        for cache in (400_000, 5):
            monkeypatch.setattr(tokenfile, "CACHE", cache)
            for t, ids in zip(texts, enc(pa.array(texts, pa.string()), 1).to_pylist()):
                assert np.frombuffer(ids, "<u2").tolist() == tok.encode(t, add_special_tokens=False).ids + [1], repr(t[:60])


def test_token_files_of_one_id(spark):
    """Rows that share an id, or have none, are cut into files like any others."""
    import public_tokenizers

    rows = [(None, f"alpha {k} beta") for k in range(300)] + [(7, f"gamma {k} delta") for k in range(300)]
    m = tokenfile.write_tokens(spark.createDataFrame(rows, "doc_id long, text string"), f"{common.shared_dir(spark)}/tokens-one", public_tokenizers.path("word_bpe_49k.json"), file_chars=1000)
    got = sorted(tokenfile.read_tokens(m, common.shared_dir(spark), ids=False).collect(), key=lambda x: x.start)
    assert m.count() > 4 and [x.doc_id for x in got] == [None] * 300 + [7] * 300
    assert [x.start for x in got] == np.cumsum([0] + [x.n_tokens for x in got])[:-1].tolist()
