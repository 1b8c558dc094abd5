"""Edge cases and brute force for the operators."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in rows], DOC)


def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and extra columns whose names clash."""
    base = prose(1, 60)
    rows = [(1, base, "en"), (2, base, "en"), (2, base, "en"), (3, None, None), (4, "", "en"), (5, "one", None), (None, base + " x", "en"), (6, prose(2, 3000), "fr"), (7, "!!! ...", "en"), (8, prose(3, 60), "en"), (8, prose(4, 60), "en")]
    return docs(spark, rows).withColumn("extra", F.lit(1))


def clash(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        return odd(spark).withColumn("TEXT", F.lit("clash"))
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


def test_only_picks_exact_names(spark):
    from tambon.llm.shared import only

    df = clash(spark)
    assert "clash" not in {r.text for r in only(df, text="string").collect()}
    assert only(df, missing="long").first()[0] is None


def test_token_files_round_trip(spark, tmp_path):
    from tokenizers import Tokenizer

    from tambon.llm import token_ids as m
    from tambon.llm.wordpiece import tokenizer_file

    path = f"file://{tmp_path}/ids"
    m.write_ids(odd(spark), path, tokenizer_file(), block_ids=500)
    got = m.read_ids(spark, path, with_ids=True).orderBy("start").collect()
    t = Tokenizer.from_file(tokenizer_file())
    rows = sorted(((r.doc_id, r.text) for r in odd(spark).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    at = 0
    assert len(got) == len(rows)
    for r, (doc, text) in zip(got, rows, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32, r.ids) == (doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at += len(ids)
    empty = f"file://{tmp_path}/none"
    m.write_ids(odd(spark).where("false"), empty, tokenizer_file())
    assert m.read_ids(spark, empty).count() == 0


@pytest.mark.parametrize("values", [[0], [5], [0, 0, 0], [1, 1, 2, 900], list(range(0, 5000, 7)), [10**6] * 3])
def test_elias_fano(values):
    from tambon.llm.token_ids import EliasFano

    e = EliasFano.from_bytes(EliasFano.of(np.array(values)).to_bytes())
    assert e.all().tolist() == values == [e.select(i) for i in range(len(values))]


def test_encoder_equals_the_library():
    import random

    from tokenizers import Tokenizer

    from tambon.llm.wordpiece import Encoder, tokenizer_file

    r, latin = random.Random(5), [chr(c) for c in range(256)]
    mixed = [*latin, *"ab \u0301.,'ſŁłΣσβ", "日", "ไ", "'s", "'re", "<|", "\u200b"]
    texts = ["".join(r.choice(some) for _ in range(r.randrange(60))) for some in (latin, mixed, "aAéÉ.,'sdD1 ½²\n\txß\xa0") for _ in range(400)]
    texts += ["", None, "y" * 3000, "a," * 900, "CAN'T 'S we'LL ''s x's.", "<|endoftext|> x", "a\x1cb", "Straße ẞ µ ª º", "été É. 12,345.67"]
    library = Tokenizer.from_file(tokenizer_file())
    want = [np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    encoder = Encoder(tokenizer_file())
    assert encoder.encode(texts) == want
    assert encoder.encode(texts) == want  # from its caches


def test_packing(spark):
    from tambon.llm import packing as m
    from tambon.llm.wordpiece import tokenizer_file

    got = m.best_fit(odd(spark), tokenizer_file(), capacity=64).toPandas()
    by = got.sort_values(["sequence_id", "offset"])
    assert (by.groupby("sequence_id").length.sum() <= 64).all()
    assert (by.groupby("sequence_id").length.cumsum() - by.length == by.offset).all()
    assert (got[got.doc_id == 3].length == 1).all() and (got.length <= 64).all()
    assert m.best_fit(odd(spark).where("false"), tokenizer_file()).count() == 0


def test_sweep_is_best_fit_decreasing():
    from tambon.llm.packing import sweep

    r = random.Random(3)
    for _ in range(30):
        cap = r.choice([7, 16, 50])
        sizes = sorted((r.randint(1, cap) for _ in range(r.randint(0, 200))), reverse=True)
        gaps = []
        for s in sizes:
            fit = [g for g in gaps if g >= s]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - s)
            else:
                gaps.append(cap - s)
        counts = {s: sizes.count(s) for s in set(sizes)}
        assert sweep(counts, cap)[1] == len(gaps)


def brute_components(ids, linked):
    label = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if linked(i, j):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    real = {c: min((ids[k] for k in range(len(ids)) if label[k] == c and ids[k] is not None), default=None) for c in label}
    return [real[c] for c in label]


def test_near_duplicates_against_brute_force(spark):
    from tambon.llm import near_dup as m

    r = random.Random(5)
    rows = [(i, t, "en") for i, t in [(x.doc_id, x.text) for x in odd(spark).collect()]]
    for k in range(6):
        base = prose(100 + k, 80).split()
        for c in range(8):
            words = list(base)
            for _ in range(r.choice([0, 1, 2, 3])):
                words[r.randrange(len(words))] = "new" + str(r.randrange(1000))
            rows.append((1000 + 10 * k + c, " ".join(words), "en"))
    got = sorted(((x.doc_id, x.n_shingles, x.component_id) for x in m.near_duplicates(docs(spark, rows), k=3, percent=85).collect()), key=str)
    sets = [set(m.shingle_set(t, 3).tolist()) for _, t, _ in rows]
    linked = lambda i, j: bool(sets[i] and sets[j]) and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])
    expected = brute_components([x[0] for x in rows], linked)
    assert got == sorted(((x[0], len(s), c) for x, s, c in zip(rows, sets, expected, strict=True)), key=str)
    assert m.near_duplicates(odd(spark).where("false")).count() == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_stage_keeps_one_row_of_each_group(spark, repeated):
    """Null ids, ids shared by different texts and repeated rows: what stays of a group doesn't depend on other rows."""
    from tambon.llm import near_dup as m

    a, b, c, d, e = (prose(700 + k, 80) for k in range(5))
    rows = [(1, a), (2, a + " more"), (None, b), (None, b), (None, b + " more"), (None, c), (7, d), (7, e), (None, None), (None, ""), (3, None)]
    rows += [(1, a), (3, None), (7, e)] if repeated else []
    left = [(r.doc_id, r.text) for r in m.keep(spark, docs(spark, [(i, t, "en") for i, t in rows]), "").collect()]
    of_b = [t for _, t in left if t and t.startswith(b)]
    assert len(of_b) == 1
    empty = [(None, None), (None, ""), (3, None)] + ([(3, None)] if repeated else [])
    assert sorted(left, key=str) == sorted([(1, a), (None, of_b[0]), (None, c), (7, d), (7, e), *empty], key=str)


def test_vectors_against_brute_force(spark):
    from tambon.llm import vector_join as m

    rng = np.random.default_rng(1)
    rows = []
    for c in range(12):
        base = rng.normal(size=8)
        rows += [(c * 10 + k, (base + rng.normal(size=8) * r).tolist(), c % 2) for k, r in enumerate([0, 0, 0.05, 0.1, 0.2])]
    rows += [(900, None, 0), (901, [0.0] * 8, 0), (902, [1.0, None] + [0.0] * 6, 0), (903, [float("nan")] * 8, 1), (904, rows[0][1], None), (905, [], 1), (906, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    m.CELL, kept = 5, m.CELL
    try:
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in m.range_links(df).collect()}
    finally:
        m.CELL = kept
    good = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)

    def linked(i, j):
        a, b = rows[i], rows[j]
        if a[2] is None or a[2] != b[2] or not good(a[1]) or not good(b[1]) or len(a[1]) != len(b[1]):
            return False
        x, y = np.array(a[1]), np.array(b[1])
        return x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98

    expected = brute_components([x[0] for x in rows], linked)
    for i, (row, c) in enumerate(zip(rows, expected, strict=True)):
        assert got[row[0]] == (sum(linked(i, j) for j in range(len(rows)) if j != i), c, row[0] == c)


def test_decontamination(spark):
    from tambon.llm import decontaminate as m

    item, short = prose(50, 40), prose(51, 15)
    edited = item.split()
    for k in (3, 15, 28, 36):
        edited[k] = "changed"
    del edited[20]
    rows = [(1, prose(60, 90) + " " + item + " " + prose(61, 90)), (2, prose(62, 33) + " " + " ".join(edited)), (3, prose(63, 500)), (4, short.upper() + "!"), (5, None), (6, ""), (7, " ".join(item.split()[:15]))]
    bench = spark.createDataFrame([(10, item), (11, short), (12, None), (13, ""), (14, item)], "item_id long, text string")
    df = docs(spark, [(i, t, "en") for i, t in rows])
    got = {(r.doc_id, r.item_id): r.distance for r in m.find(df, bench).collect()}
    assert got == {(1, 10): 0, (1, 14): 0, (2, 10): 5, (2, 14): 5, (4, 11): 0}
    assert m.find(df.where("false"), bench).count() == 0 and m.find(df, bench.where("false")).count() == 0


def test_decontamination_recall():
    from tambon.llm import decontaminate as m

    r = random.Random(9)
    items = [(k, m.words(prose(1000 + k, r.randint(15, 59)))) for k in range(60)]
    index = m.Index(items, m.STRIDE, m.SIMILARITY)
    for rate, least in ((0.0, 1.0), (0.1, 0.98), (0.2, 0.9)):
        found = 0
        for k, item in items:
            words = item.tolist()
            for _ in range(int(rate * len(item))):
                words[r.randrange(len(words))] = r.getrandbits(63)
            text = np.concatenate([m.words(prose(5000 + k, 30 + k % 8)), np.array(words, np.uint64), m.words(prose(9000 + k, 50))])
            found += any(x[1] == k for x in index.matches([text]))
        assert found >= least * len(items)


@pytest.mark.parametrize("size", [5, 12, 13, 15, 23, 39, 40, 42, 44, 46, 48, 60, 80])
def test_decontamination_recall_by_kind_of_edit(size):
    """All the edits that the distance allows, of one kind."""
    from tambon.llm import decontaminate as m

    r = random.Random(size)
    new = lambda n: [r.getrandbits(63) | 1 for _ in range(n)]
    items = [(k, np.array(new(size), np.uint64)) for k in range(100)]
    least = m.shortest(size, m.SIMILARITY)
    index = m.Index(items, m.STRIDE if least >= m.STRIDE + m.LENGTHS[0] - 1 else 1, m.SIMILARITY)
    for kind in ("deleted", "inserted", "substituted"):
        texts = []
        for _, item in items:
            words = item.tolist()
            for at in sorted(r.sample(range(size), size - least), reverse=True):
                words[at : at + (kind != "inserted")] = new(kind != "deleted")
            texts.append(np.array([*new(20 + r.randrange(8)), *words, *new(40)], np.uint64))
        found = {x[:2] for x in index.matches(texts)}
        assert sum((k, k) in found for k in range(100)) >= 95, kind


def test_language(spark):
    from tambon.llm import language_id as m

    en, fr = "the of and with that which from".split(), "le de et avec que dans pour".split()
    r = random.Random(1)
    rows = [(k, " ".join(r.choice(en if k % 2 else fr) for _ in range(30)), "en" if k % 2 else "fr") for k in range(60)]
    model = m.fit(docs(spark, rows))
    test = [(100, "with thatful the", None), (101, "dansons que le", None), (102, None, None), (103, "12 !!", None), (104, "", None), (105, "the " * 20000, None)]
    got = {x.doc_id: (x.lang_pred, x.score) for x in m.identify(docs(spark, test), model).collect()}
    assert [got[k][0] for k in range(100, 106)] == ["en", "fr", "und", "und", "und", "en"]
    assert all(0 <= s <= 1 for _, s in got.values()) and got[102][1] == 0
    nothing = m.fit(docs(spark, rows).where("false"))
    assert {x.lang_pred for x in m.identify(docs(spark, test), nothing).collect()} == {"und"}


def test_toxicity(spark):
    from tambon.llm import toxicity as m

    r = random.Random(2)
    rows = [(k, prose(2000 + k, 40) + (" you grubnik " if k % 4 == 0 else " ") + prose(3000 + k, 5), "en") for k in range(400)]
    df = docs(spark, rows)
    labels = m.trusted_labels(spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (399, None)], "doc_id long, toxic int"))
    model = m.fit(df.select("doc_id", "text"), labels)
    test = docs(spark, [(1, prose(1, 50) + " grubnik", "en"), (2, prose(2, 50), "en"), (3, None, "en"), (4, "", "en"), (5, prose(3, 50) + " GRUBN1K!", "en")])
    got = {x.doc_id: (x.predicted, x.score) for x in m.score(test, model).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4)] == [1, 0, 0, 0] and all(0 <= s <= 1 for _, s in got.values())
    assert got[5][0] == 1
    none = m.fit(df.select("doc_id", "text"), labels.where("false"))
    assert {x.score for x in m.score(test, none).collect()} == {0.0}
    assert r


def test_isotonic():
    from tambon.llm.toxicity import isotonic

    ends, values = isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]), np.ones(5))
    assert values.tolist() == [0, 0.5, 1] and ends.tolist() == [1, 3, 4]


def test_quality_model_against_direct_kneser_ney(spark):
    from collections import Counter

    from tambon.llm import quality_lm as m

    r = random.Random(4)
    rows = [(k, " ".join(r.choice(WORDS) for _ in range(40)), "en") for k in range(40)]
    df = docs(spark, rows)
    model, counts = m.train(df)
    got = {x.doc_id: x.log_perplexity for x in m.perplexity(df.withColumn("trusted", F.lit(True)), model, counts).collect()}
    pairs = Counter(p for _, t, _ in rows for p in zip(["<s>", *t.split()], t.split(), strict=False))
    n = [sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]
    d = m.discounts(np.array(n))
    total, kinds, into = Counter(), Counter(), Counter()
    for (v, w), c in pairs.items():
        total[v] += c
        kinds[v] += d[min(c, 3)]
        into[w] += 1
    e = m.discounts(np.array([sum(c == k for c in into.values()) for k in (1, 2, 3, 4)]))
    whole = sum(into.values())
    mass = sum(e[min(c, 3)] for c in into.values()) / whole
    low = lambda w: (into[w] - e[min(into[w], 3)]) / whole + mass / (len(WORDS) + m.FIRST)
    for k, t, _ in rows:
        logs = [np.log((pairs[v, w] - d[min(pairs[v, w], 3)]) / total[v] + kinds[v] / total[v] * low(w)) for v, w in zip(["<s>", *t.split()], t.split(), strict=False)]
        assert got[k] == pytest.approx(-np.mean(logs), rel=1e-4)


def direct_kneser_ney(texts, m):
    """Text to log-perplexity, by the formula over all words of `texts`."""
    from collections import Counter

    split = lambda t: list(map(m.normal, t.split()))
    pairs = Counter(p for t in texts for p in zip(["<s>", *split(t)], split(t), strict=False))
    d = m.discounts(np.array([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)]))
    total, kinds, into = Counter(), Counter(), Counter()
    for (v, w), c in pairs.items():
        total[v] += c
        kinds[v] += d[min(c, 3)]
        into[w] += 1
    e = m.discounts(np.array([sum(c == k for c in into.values()) for k in (1, 2, 3, 4)]))
    whole = sum(into.values())
    mass = sum(e[min(c, 3)] for c in into.values()) / whole
    low = lambda w: (into[w] - e[min(into[w], 3)]) / whole + mass / (len(into) + m.FIRST)

    def of(text):
        words = split(text)
        return -np.mean([np.log(max(0, pairs[v, w] - d[min(pairs[v, w], 3)]) / total[v] + kinds[v] / total[v] * low(w) if total[v] else low(w)) for v, w in zip(["<s>", *words], words, strict=False)])

    return of


@pytest.mark.parametrize("kinds, head", [(70_000, None), (300, 40)])
def test_quality_model_counts_every_word(spark, kinds, head):
    """More kinds than have numbers: those outside the head count as much, and words never seen get the uniform share."""
    from tambon.llm import quality_lm as m

    r = random.Random(8)
    words = [f"kind{k}" for k in range(kinds)]
    tokens = words * 2 + words[: kinds // 2] + words[-50:] * 4
    r.shuffle(tokens)
    texts = [" ".join(tokens[k : k + 1000]) for k in range(0, len(tokens), 1000)]
    model, counts = m.train(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]), **({"head": head} if head else {}))
    asked = texts[:3] + [" ".join(r.choice([*words, "never", "seen"]) for _ in range(60)) for _ in range(20)] + ["never", "seen never", words[-1], " ".join(texts[0].split()[:9] * 5)]
    df = docs(spark, [(k, t, "en") for k, t in enumerate(asked)]).withColumn("trusted", F.lit(False))
    got = {x.doc_id: x.log_perplexity for x in m.perplexity(df, model, counts).collect()}
    direct = direct_kneser_ney(texts, m)
    for k, t in enumerate(asked):
        assert got[k] == pytest.approx(direct(t), rel=1e-4)


def test_quality_of_a_word_repeated_200000_times(spark):
    from tambon.llm import quality_lm as m

    texts = [prose(300 + k, 200) for k in range(5)] + ["alpha1 alpha1 beta2 alpha1 beta2 beta2"]
    model, counts = m.train(docs(spark, [(k, t, "en") for k, t in enumerate(texts)]))
    asked = ["alpha1 " * 200_000, "alpha1 beta2 " * 100_000]
    df = docs(spark, [(k, t, "en") for k, t in enumerate(asked)]).withColumn("trusted", F.lit(False))
    got = {x.doc_id: x.log_perplexity for x in m.perplexity(df, model, counts).collect()}
    direct = direct_kneser_ney(texts, m)
    for k, t in enumerate(asked):
        assert got[k] == pytest.approx(direct(t), rel=1e-4)


def test_quality_of_rare_languages(spark):
    """Languages with one to five trusted documents keep their clean ones, beside one with many, which still loses its junk."""
    from tambon.llm import quality_lm as m

    r = random.Random(12)
    text = lambda lang: " ".join(r.choice(WORDS) + lang + str(int(r.paretovariate(0.7)) % 60) for _ in range(r.randint(40, 120)))
    rows, good, clean, junk = [], [], {}, []
    for k in range(600):
        rows.append((k, text("en"), "en"))
        if k < 400:
            good.append(k)
    for n in range(1, 6):
        clean[f"l{n}"] = range(1000 * n + 5, 1000 * n + 65)
        good += range(1000 * n, 1000 * n + n)
        rows += [(k, text(f"l{n}"), f"l{n}") for k in [*range(1000 * n, 1000 * n + n), *clean[f"l{n}"]]]
    for k in range(9000, 9040):
        rows.append((k, " ".join(f"{r.getrandbits(40):x}" for _ in range(60)), "en"))
        junk.append(k)
    labels = spark.createDataFrame([(k, 1) for k in good], "doc_id long, quality int")
    kept = {x.doc_id: x.kept for x in m.judge(spark, docs(spark, rows), labels).collect()}
    for n in range(1, 6):
        assert np.mean([kept[k] for k in clean[f"l{n}"]]) >= 0.95
    assert not any(kept[k] for k in junk) and np.mean([kept[k] for k in range(600)]) >= 0.95


def test_quality_edges(spark):
    from tambon.llm import quality_lm as m

    rows = odd(spark)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(x.kept for x in m.judge(spark, rows, none).collect())
    labels = spark.createDataFrame([(k, 1) for k in (1, 6, 8)] + [(None, 1), (4, None)], "doc_id long, quality int")
    got = m.judge(spark, rows, labels).collect()
    assert len(got) == rows.select("doc_id", "text").distinct().count()
    assert all(not x.kept and x.perplexity is None for x in got if x.n_words == 0)


def test_url_filter(spark):
    from tambon.llm import url_filter as m

    captures = spark.createDataFrame([(1, "http://www.A.example.org/x/y?q", "2024-01-05"), (2, "https://a.example.org/x", "2024-02-05"), (3, "http://b.org/d/e", "2024-01-09"), (3, "http://b.org/d/e", "2024-01-09"), (4, None, "2024-01-01"), (5, "nonsense", "2024-01-01"), (6, "http://u@example.org:80", None), (7, "http://example.org.", "2024-01-01")], "page_id long, url string, fetched string").withColumn("fetched", F.to_date("fetched"))
    entries = spark.createDataFrame([("d:example.org", "add", "2024-01-01"), ("d:example.org", "remove", "2024-02-01"), ("p:b.org/d", "add", "2024-01-09"), ("p:b.org/d", "add", "2024-01-09"), (None, "add", "2024-01-01")], "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    got = sorted(((r.page_id, r.blocked, r.pattern) for r in m.judge(captures, entries).collect()), key=str)
    assert got == [(1, True, "d:example.org"), (2, False, None), (3, True, "p:b.org/d"), (3, True, "p:b.org/d"), (4, False, None), (5, False, None), (6, False, None), (7, True, "d:example.org")]


def test_url_filter_of_deep_folders(spark):
    from tambon.llm import url_filter as m

    captures = spark.createDataFrame([(1, "http://b.org/a/b/c/d.html"), (2, "http://b.org/a/b/x/d.html"), (3, "http://b.org/a/b/c/d/e/f?q"), (4, "http://b.org/a/b")], "page_id long, url string").withColumn("fetched", F.to_date(F.lit("2024-01-05")))
    lists = lambda *p: spark.createDataFrame([(x, "add", "2024-01-01") for x in p], "pattern string, action string, day string").withColumn("day", F.to_date("day"))
    judged = lambda *p: {r.page_id: r.pattern for r in m.judge(captures, lists(*p)).collect()}
    assert judged("p:b.org/a/b/c") == {1: "p:b.org/a/b/c", 2: None, 3: "p:b.org/a/b/c", 4: None}
    assert judged("p:b.org/a/b/c/d/e", "p:b.org/a/b/x") == {1: None, 2: "p:b.org/a/b/x", 3: "p:b.org/a/b/c/d/e", 4: None}
    assert not any(judged("d:c.org").values())


def test_quotations_of_short_lines(spark):
    from tambon.llm import quotations as m

    rows = [(1, 0, "user", "Yes.\nCall me tomorrow after noon.\nNo."), (1, 1, "bot", "> Yes.\nFine"), (2, 0, "user", "Yes.\nThat is all that I know."), (2, 1, "user", "Maybe\nYes."), (2, 2, "bot", "> Yes.\n> That is all that I know.\nI see"), (1, 2, "bot", "> Yes.\n> No.\nBoth?")]
    got = {(r.conv_id, r.turn): r.parent_turn for r in m.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(1, 0): None, (1, 1): 0, (1, 2): 0, (2, 0): None, (2, 1): None, (2, 2): 0}


def test_quotations(spark):
    from tambon.llm import quotations as m

    rows = [(1, 0, "user", "Where is the\nlibrary today?"), (1, 1, "bot", "It is down the street."), (1, 2, "user", "On Monday bot wrote:\n> It is   down the street.\n>> Where is the library today?\nThanks!"), (1, 3, "bot", "> Where is the\n> library today?\n"), (1, 4, "user", None), (2, 0, "user", "> It is down the street."), (None, 0, "x", "> hm"), (1, 5, "user", "> Thanks!\nok")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(0))
    got = {(r.conv_id, r.turn): r for r in m.link(df).collect()}
    assert len(got) == len(rows)
    assert (got[1, 2].parent_turn, got[1, 2].text, got[1, 2].n_quotes) == (1, "Thanks!", 2)
    assert (got[1, 3].parent_turn, got[1, 3].text) == (0, "")
    assert got[1, 5].reply_path == [1, 2, 5] and got[1, 5].depth == 2 and got[1, 5].thread_turn == 1
    assert got[2, 0].parent_turn is None and got[1, 4].text is None and got[None, 0].parent_turn is None


def test_quotations_against_brute_force(spark):
    import random

    from tambon.llm import quotations as m

    r, lines = random.Random(3), ["Yes.", "See you at the station tomorrow.", "No, thank you very much.", "Where is it?"]
    rows = []
    for conv in (1, 2, 3):
        for turn in sorted(r.sample(range(5000), 150)):
            quote = "".join(f"> {line}\n" for line in r.sample(lines, r.randrange(3)))
            rows.append((conv, turn, "user", quote + "\n".join([f"text {conv} {turn}", *r.sample(lines, r.randrange(2))])))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(x.conv_id, x.turn): x for x in m.link(df).collect()}
    own = {(c, t): (m.passages(x)[0], m.passages(x)[1]) for c, t, _, x in rows}
    paths = {}
    for (conv, turn), (_, quotes) in sorted(own.items()):
        found = [(level, i, short, -t) for i, (level, q) in enumerate(quotes) for h, short in m.hashes(q).items() for (c, t), (body, _) in own.items() if c == conv and t < turn and h in m.hashes(body)]
        parent = -min(found)[3] if found else None
        paths[conv, turn] = [*(paths[conv, parent] if found else []), turn]
        assert (got[conv, turn].parent_turn, got[conv, turn].reply_path) == (parent, paths[conv, turn])
    for conv in (1, 2, 3):
        order = sorted((k for k in paths if k[0] == conv), key=paths.get)
        assert [got[k].position for k in order] == list(range(len(order)))


def test_quotations_on_empty_and_repeated_rows(spark):
    from tambon.llm import quotations as m

    kind = "conv_id long, turn long, role string, text string"
    assert m.link(spark.createDataFrame([], kind)).count() == 0
    rows = [(1, 0, "a", "The first of all lines."), (1, 0, "a", "The first of all lines."), (1, 1, "b", "> The first of all lines.\nok " + "long " * 50_000), (1, None, "b", "> The first of all lines."), (None, None, None, None), (None, 1, "a", "x")]
    got = m.link(spark.createDataFrame(rows, kind)).collect()
    assert sorted(x.position for x in got if x.conv_id) == [0, 1, 2, 3] and [x.position for x in got if x.conv_id is None] == [None, None]
    assert [x.parent_turn for x in got if x.turn == 1 and x.conv_id] == [0]
    one = spark.createDataFrame([(7, t, "a", f"line {t}") for t in range(4000)], kind).repartition(8)
    assert sorted(x.position for x in m.link(one).select("turn", "position").where("turn = position").collect()) == list(range(4000))


def test_pipeline_stages_keep_the_columns():
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_quality_of_counted_documents_is_that_without_them(spark):
    """A document that the model has counted scores nearly as under a model that hasn't."""
    from tambon.llm import quality_lm as m

    r = random.Random(21)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[min(399, int(r.paretovariate(0.5)))] for _ in range(80)) + f" own{k} words{k}" for k in range(120)]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    model, counts = m.train(docs(spark, rows), head=200)
    score = lambda model, counts, counted: {x.doc_id: x.log_perplexity for x in m.perplexity(docs(spark, rows[:5]).withColumns({"trusted": F.lit(True), "counted": F.lit(counted)}), model, counts).collect()}
    known, left_out = score(model, counts, False), score(model, counts, True)
    for k in (0, 3):
        without = score(*m.train(docs(spark, rows).where(F.col("doc_id") != k), head=200), False)[k]
        assert known[k] < left_out[k] and abs(left_out[k] - without) < 0.15 * (without - known[k]) + 0.05


@pytest.mark.parametrize("size", [1, 2, 3])
def test_decontamination_of_items_of_few_words(spark, size):
    """Items too short for a window are found wherever they stand as they are, at the ends of texts too, and never across two texts."""
    from tambon.llm import decontaminate as m

    items = [(k, " ".join(f"item{k}x{n}" for n in range(size))) for k in range(60)]
    rows = [(k, prose(k, 20) + " " + text + (" " + prose(k + 500, 9) if k % 3 else ""), "en") for k, text in items]
    rows += [(1000, prose(77, 40) + " item1x0", "en"), (1001, "item1x1 item1x2 " + prose(78, 40), "en"), (1002, None, "en"), (1003, "", "en")]
    bench = spark.createDataFrame([*items, (900, items[5][1].upper() + "!")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in m.find(docs(spark, rows), bench).collect()}
    expected = {(k, k, 0) for k, _ in items} | {(5, 900, 0)} | ({(1000, 1, 0)} if size == 1 else set())
    assert got == expected


def test_toxicity_of_labels_without_documents(spark):
    """Labels that match no document teach nothing, and an empty table of documents is no error."""
    from tambon.llm import toxicity as m

    df = docs(spark, [(k, prose(k, 30) + " grubnik" * (k % 2), "en") for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(1000 + k, 1) for k in range(500)], "doc_id long, toxic int")
    alone = labels.where("doc_id < 60")
    assert m.fit(df, labels).share == m.fit(df, alone).share == 0.5
    empty = df.where("false")
    model = m.fit(empty, labels)
    assert m.score(empty, model).count() == 0 and [x.score for x in m.score(df.limit(1), model).collect()] == [0.0]


@pytest.mark.parametrize("capacity", [64, 40_000, 70_000])
def test_packing_of_any_capacity(spark, capacity):
    """No two pieces share a place, and sequences have no gaps before their last piece."""
    from tambon.llm import packing as m

    rows = [(k, int(n)) for k, n in enumerate(np.random.default_rng(3).integers(1, capacity + 1, 300))] + [(900, capacity), (901, capacity)]
    pieces = spark.createDataFrame([(k, 0, 0, n, 0) for k, n in rows], "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = m.pack(pieces, capacity).toPandas().sort_values(["sequence_id", "offset"])
    assert len(got) == len(rows) and (got.groupby("sequence_id").length.sum() <= capacity).all()
    assert (got.groupby("sequence_id").length.cumsum() - got.length == got.offset).all()
    with pytest.raises(ValueError):
        m.pack(pieces, 1 << 22)


def test_token_files_hold_every_id(spark, tmp_path):
    from tambon.llm import token_ids as m
    from tambon.llm.wordpiece import tokenizer_file

    ids = [None, -(1 << 63), -1, 0, (1 << 63) - 1, None]
    m.write_ids(docs(spark, [(k, "one two", "en") for k in ids]), f"file://{tmp_path}/all", tokenizer_file())
    got = sorted(m.read_ids(spark, f"file://{tmp_path}/all").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, -(1 << 63), -1, 0, (1 << 63) - 1]


def test_long_words_teach_languages_whole(spark):
    from tambon.llm import language_id as m

    long = "donaudampfschifffahrtsgesellschaftskapitaenswitwenrente"
    model = m.fit(docs(spark, [(k, f"{long} und", "de") for k in range(9)] + [(k + 50, "the and of", "en") for k in range(9)]))
    assert long in model.words and long[:40] not in model.words


@pytest.mark.parametrize("stage", range(5))
def test_stages_on_clashing_names_and_empty_tables(spark, stage, tmp_path):
    """A second column TEXT beside text, null and repeated ids: stages run, keep the columns, and are given nothing without complaint."""
    import corpus_pipeline

    name, of = corpus_pipeline.STAGES[stage]
    spark.createDataFrame([(900, prose(50, 40))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, 1, 0), (6, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    df = odd(spark)
    left = of(spark, df, str(tmp_path))
    assert name == "best_fit_packing" or left.columns == df.columns
    assert left.count() > 0
    assert of(spark, df.where("false"), str(tmp_path)).count() == 0
