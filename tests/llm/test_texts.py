import random

import numpy as np
import pytest

from shelfmark.llm import bpe, mixing, spam, toxicity
from shelfmark.llm.sources import source_name

NASTY = [None, "", " ", "\n\n\t x  y ", "<|endoftext|> it's", "a" * 3001, " " * 999 + "x", "日本語のテキスト" * 300, "naïve café — don’t", "\x00\x01", "👩‍👩‍👧 ok", "퟿", "x" * 100_000]


def test_ids_equal_a_reference_encoder(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    rng = random.Random(1)
    words = [" the", "Ship", " über", "12345", "!!", "\n", " 漢字", "'ll", "aaaa", "zzzzzz"]
    texts = NASTY + ["".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(200)]
    rows = [(k, x, "ids") for k, x in enumerate(texts)] + [(None, "x", "ids"), (0, None, "ids")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = bpe.encode_corpus(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    found = {r.doc_id: r.ids for r in got if r.doc_id}
    coder = bpe.encoder(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    for k, x in enumerate(texts):
        if k:
            assert found[k] == t.encode(x or "", add_special_tokens=False).ids
            assert coder.decode(found[k]) == (x or "")
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df, "doc_id", "text").collect() if r.doc_id} == {k: len(v) for k, v in found.items()}
    assert bpe.encode_corpus(df.limit(0), "doc_id", "text").collect() == []


def test_long_words_equal_a_reference_encoder():
    import time

    from tokenizers import Tokenizer

    path = f"{bpe.TOKENIZERS}/byte_bpe_50k.json"
    t, coder = Tokenizer.from_file(path), bpe.encoder(path)
    rng = random.Random(2)
    letters = ["abcdefghijklmnopqrstuvwxyz", "etaoin", "ab", "的一是不了人我在有他这中大来", "กขคงจฉชซ", "ABCdefGHI", "a"]
    words = ["".join(rng.choices(x, k=n)) for x in letters for n in (60, 129, 200, 1000, 3000)]
    words += ["".join(rng.choices(["the", "ing", "tion", "straw", "berry"], k=200)), "=" * 777, "ab" * 500 + "a" * 500, "x" + "aaaa" * 300 + "y"]
    got = coder.encode(words)
    for w, ids in zip(words, got, strict=True):
        assert ids.tolist() == t.encode(w, add_special_tokens=False).ids, w[:40]
    blob = "".join(rng.choices(letters[0], k=200_000))
    began = time.time()
    ids = coder.encode([blob])[0].tolist()
    assert time.time() - began < 15
    assert ids == t.encode(blob, add_special_tokens=False).ids


def test_disguises():
    c = toxicity.comparable
    assert c("You a s s h o l e") == "you asshole"
    assert c("n4k3d") == "naked" and c("nakeddd") == "naked"
    assert c("fuсkіng") == "fucking"
    assert c("ge­nitals") == "genitals"
    assert c("ÉTÉ  2024") == "ete 0"
    assert c(None) == c("") == c(" \n") == ""


def _abuse(n, seed):
    rng = random.Random(seed)
    calm = ["The {} stands near the harbour.", "Two people carry a {} up the hill.", "A damn good {} in the rain.", "The nurse explains the {} to adults."]
    bad = ["You worthless {} nobody wants you here.", "Round up those {} people and sink the boat.", "I will find you and break your {}."]
    things = ["ladder", "lantern", "umbrella", "teapot", "bicycle", "violin"]
    texts, labels = [], []
    for _ in range(n):
        is_bad = rng.random() < 0.25
        s = [rng.choice(calm).format(rng.choice(things)) for _ in range(rng.randint(1, 12))]
        if is_bad:
            s.insert(rng.randint(0, len(s)), rng.choice(bad).format(rng.choice(things)))
        texts.append(" ".join(s))
        labels.append(is_bad)
    return texts, labels


def test_held_out_accuracy(spark):
    model = toxicity.train(*_abuse(500, 1))
    texts, labels = _abuse(300, 2)
    rows = [("d", k, t, 0.5) for k, t in enumerate(texts)]
    odd = [("d", 1000, None, 0.5), ("d", 1001, "", 0.5), ("d", 1002, " \n ", 0.5), (None, None, texts[0], None), ("d", 1003, "calm water. " * 20_000 + "You worthless teapot nobody wants you here.", 0.5)]
    df = spark.createDataFrame(rows + odd, "rec_kind string, rec_id bigint, text string, score double")
    got = {r.rec_id: r.score for r in toxicity.score_texts(df, model).collect()}
    right = sum((got[k] >= 0.5) == b for k, b in enumerate(labels))
    assert right >= 0.97 * len(labels)
    assert got[1000] == got[1001] == got[1002] == 0
    assert got[1003] >= 0.5
    assert toxicity.score_texts(df.limit(0), model).collect() == []


@pytest.mark.parametrize("rate", [0.03, 0.2, 0.4])
def test_any_rate_of_bad_texts(spark, rate):
    texts, labels = _abuse(4000, 3)
    bad, good = ([t for t, b in zip(texts, labels, strict=True) if b is x] for x in (True, False))
    bad = bad[: int(rate * 1500)]
    rows = [("d", k, t) for k, t in enumerate(bad + good[: 1500 - len(bad)])]
    model = toxicity.train(*_abuse(500, 1))
    got = {r.rec_id: r.score >= 0.5 for r in toxicity.score_texts(spark.createDataFrame(rows, "rec_kind string, rec_id bigint, text string"), model).collect()}
    assert sum(got[k] for k in range(len(bad))) >= 0.95 * len(bad)
    assert sum(got[k] for k in range(len(bad), len(rows))) <= 0.03 * len(rows)


def test_a_task_fits_the_same_model(spark):
    texts, labels = _abuse(300, 1)
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*texts, None])], "doc_id bigint, text string, label string")
    reviews = spark.createDataFrame([(k, " Abusive" if b else "none") for k, b in enumerate(labels)] + [(300, "none"), (0, None), (None, "sexual")], "doc_id bigint, label string")
    a, b = toxicity.fitted(docs, reviews), toxicity.train(texts, labels)
    assert (a.weights == b.weights).all() and (a.threshold, a.bias) == (b.threshold, b.bias)
    none = toxicity.fitted(docs, reviews.limit(0))
    assert (none.scores(["anything"]) < none.threshold).all()


def test_long_bad_texts_are_trained_on_their_worst_windows():
    rng = random.Random(6)
    calm = lambda n: [f"The {rng.choice(['ladder', 'teapot', 'violin'])} stands near the {rng.choice(['harbour', 'hill', 'garden'])}." for _ in range(n)]
    texts, labels = [], []
    for k in range(200):
        s = calm(150)
        if k % 4 == 0:  # one attack in about 250 windows
            s.insert(rng.randint(0, 150), "You worthless thing nobody wants you here, go away and never come back to us.")
        texts.append(" ".join(s))
        labels.append(k % 4 == 0)
    model = toxicity.train(texts, labels)
    assert len(model.held) == len(labels)  # no right label is set aside
    assert ((model.held >= model.threshold) == (model.label > 0)).all()
    assert ((model.scores([toxicity.comparable(t) for t in texts]) >= model.threshold) == np.array(labels)).all()


def test_no_labels_no_cases():
    model = toxicity.train([], [])
    assert (model.scores(["anything"]) < model.threshold).all()
    assert (toxicity.train(["a b c"], [True]).scores(["a b c"]) < 0).all()


def _pages(n, seed):
    rng = random.Random(seed)
    goods = ["phone case", "lens filter", "wall print", "usb hub"]
    places = ["harbour", "attic", "garden", "kitchen", "station", "quarry"]
    out = []
    for k in range(n):
        kind = k % 5
        if kind == 0:
            g = rng.choice(goods)
            out.append((" | ".join(rng.choice([f"cheap {g}", g, f"{g} sale", f"buy {g} online"]) for _ in range(25)), True))
        elif kind == 1 and k % 2:
            out.append((" ".join(f"https://www.shop{rng.randint(1, 999)}.example/p-{rng.randint(1, 9999)}" for _ in range(15)), True))
        else:
            out.append((" ".join(f"The {rng.choice(places)} was quiet when we came to the {rng.choice(places)} with an umbrella." for _ in range(rng.randint(2, 12))), False))
    return out


def test_spam_pages(spark):
    pages = _pages(600, 4)
    rows = [(k, t, f"host{k % 7}" if k % 3 else None, 0.5) for k, (t, _) in enumerate(pages)]
    rows += [(900, None, "h", 1.0), (901, "", None, 1.0), (902, "  ", "h", 1.0), (903, "word " * 40_000, "h", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, host string, score double")
    got = {r.doc_id: r.score for r in spam.score_pages(df, "doc_id", "text", "host").collect()}
    assert len(got) == len(rows)
    assert sum((got[k] > 0.5) == b for k, (_, b) in enumerate(pages)) >= 0.98 * len(pages)
    assert got[900] == got[901] == got[902] == 0
    assert spam.score_pages(df.limit(0), "doc_id", "text", "host").collect() == []


def test_all_telling_words_count_however_many(spark):
    rows = [(k, None, " ".join(f"word{chr(97 + k // 4)}{chr(97 + j)}" for j in range(24)) + f" https://shop{k}.example/" + "p" * 900) for k in range(40)]
    rows += [(100 + k, "h", t) for k, (t, _) in enumerate(_pages(100, 5))] + [(None, None, None), (300, None, " "), (301, None, rows[0][2]), (301, None, rows[0][2])]
    df = spark.createDataFrame(rows, "id bigint, host string, text string")
    split = spam.split_pages(df, "id", "text", "host")
    words = spam.word_odds(split)
    n = words.count()
    assert n >= 240  # of ten groups of pages, each with its own words
    key = lambda r: str((r.id, r.host, r.label, r.x))
    sent = sorted(map(key, spam.measure_pages(split, words, n).collect()))
    assert sent == sorted(map(key, spam.measure_pages(split, words, 20).collect())) and len(sent) == len(rows)
    hot = {r.id: r.x[spam._F["hot_word_share"]] for r in spam.measure_pages(split, words, 20).collect() if r.x}
    assert min(hot[k] for k in range(40)) == 1.0


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 1] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    f = spam.Forest(x[:500], y[:500], trees=15)
    assert ((f.predict(x[500:]) > 0.5) == y[500:]).mean() > 0.95


def test_the_weight_of_hosts_is_fitted():
    rng = np.random.default_rng(1)
    label = (rng.random(4000) < 0.4).astype(int)
    page = 1 / (1 + np.exp(-(2 * label - 1 + rng.normal(0, 1, 4000))))
    assert spam.fit_host_weight(page, rng.normal(0, 1, 4000), label) <= 0.1
    assert spam.fit_host_weight(page, (2 * label - 1) * 2.0 + rng.normal(0, 1, 4000), label) >= 0.5


def _mix_tables(spark):
    rng = random.Random(2)
    rows = []
    for k in range(600):
        s = rng.choices(["web", "Notes ", "talk"], weights=[6, 1, 3])[0]
        rows.append((k, f"{s} " + " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(rng.randint(3, 30))) + f" {k}", s, 9))
    rows += [(700 + k, "the very same text", "web", 9) for k in range(300)]
    rows += rows[:50]
    rows += [(1100, None, "web", 9), (1101, "", "talk", 9), (1102, "no source here", None, 9), (1103, "other", "elsewhere", 9), (1104, "web alpha beta", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens int")
    targets = spark.createDataFrame([("WEB", 3.0, 1), ("notes", 1.0, 4), ("talk", 1.0, 2), ("missing", 1.0, 3), (None, 1.0, 1), ("notes", None, 5)], "source string, weight double, max_repeats int")
    return docs, targets


def test_mixture_meets_its_targets(spark):
    docs, targets = _mix_tables(spark)
    m = mixing.mix(docs, targets)
    report = {r.source: r for r in m.report.collect()}
    assert report["missing"].share == 0 and report["missing"].target_share == 0
    for name, want in (("web", 0.6), ("notes", 0.2), ("talk", 0.2)):
        assert report[name].target_share == pytest.approx(want)
        assert report[name].share == pytest.approx(want, abs=0.01)
    used = m.texts.collect()
    limits = {"web": 1, "notes": 4, "talk": 2}
    assert all(1 <= r.copies <= limits[r.source] for r in used)
    ids = {r.doc_id for r in used}
    assert len(ids & set(range(700, 1000))) <= 1  # copies are one text
    assert not ids & {1100, 1101, 1103}
    assert all(r.settled for r in report.values())


def test_a_text_also_found_elsewhere_stays(spark):
    rows = [(k, f"text number {k}", "web") for k in range(20)] + [(100, "text number 3", "elsewhere"), (101, "only there", "elsewhere")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    m = mixing.mix(docs, spark.createDataFrame([("web", 1.0, 1)], "source string, weight double, max_repeats int"))
    assert {r.doc_id: r.copies for r in m.texts.collect()} == {k: 1 for k in range(20)}


def test_mixture_of_nothing(spark):
    docs, targets = _mix_tables(spark)
    m = mixing.mix(docs.limit(0), targets)
    assert m.texts.collect() == [] and all(r.share == 0 for r in m.report.collect())


def test_source_names(spark):
    df = spark.createDataFrame([(" OCR\n",), ("import-page",), ("Import Page",), ("  ",), (None,)], "s string")
    assert [r[0] for r in df.select(source_name(df.s)).collect()] == ["ocr", "import_page", "import_page", None, None]
