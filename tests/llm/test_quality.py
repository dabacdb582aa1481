"""Rules (op1), classifier (op5) and personal data (op6): held-out accuracy and edge cases."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperloom.llm import pii, puquality, rules
from paperloom.llm.textstats import NAMES, statistics

WORDS = "the of stone river morning letter walked quiet garden window answer people under bridge".split()


def good(rng):
    return " ".join(rng.choice(WORDS, int(rng.integers(30, 80)))).capitalize() + "."


def bad(rng):
    return " ".join(["buy now!!!", "$$$ 99%", "click here ###"][int(i)] for i in rng.integers(0, 3, int(rng.integers(8, 20))))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = [(i, good(rng) if i % 3 else bad(rng), "x") for i in range(600)]
    docs = spark.createDataFrame([*rows, (None, "a text without an id", "x"), (900, None, "x"), (901, "", "x"), (902, "  \n ", "x"), (1, rows[1][1], "x"), (903, "word " * 60000, "x")], "doc_id bigint, text string, quality string").cache()
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300)] + [(None, 1, 0), (5, None, 0)], "doc_id bigint, quality int, toxic int").cache()
    return docs, labels


def test_rules_hold_out_and_edges(spark, corpus):
    docs, labels = corpus
    got = {(r.doc_id): r.rule for r in rules.judged(docs, labels).collect()}
    held = [i for i in range(300, 600)]
    assert np.mean([(got[i] == 0) == bool(i % 3) for i in held]) > 0.97
    assert got[900] == got[901] == got[902] == -1 and None in got
    assert rules.judged(docs, labels).count() == docs.count()
    empty = rules.judged(docs.limit(0), labels.limit(0))
    assert empty.count() == 0 and empty.columns == ["doc_id", "rule"]
    assert {r.rule for r in rules.judged(docs, labels.where("quality = 1")).collect()} == {0, -1}


def test_conditional_is_the_rule_list(spark):
    rng = np.random.default_rng(4)
    x = rng.random((400, len(NAMES)))
    is_bad = ((x[:, 2] > 0.7) & (x[:, 4] < 0.5)) | (x[:, 6] > 0.93)
    learnt = rules.learn(x, is_bad)
    assert learnt
    table = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["i int", *(f"{n} double" for n in NAMES)]))
    chain = {r.i: r.rule for r in table.select("i", rules.decision(learnt).alias("rule")).collect()}
    for i, row in enumerate(x):
        assert chain[i] == next((k for k, r in enumerate(learnt, 1) if rules.covers(r, row[None])[0]), 0)
    assert np.mean([(chain[i] > 0) == b for i, b in enumerate(is_bad)]) > 0.9


def test_classifier_hold_out_and_edges(spark, corpus):
    docs, labels = corpus
    kept = puquality.keep_good(docs, labels.withColumn("text", labels.quality.cast("string")))
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert np.mean([(i in set(ids)) == bool(i % 3) for i in range(600)]) > 0.95
    assert not {900, 901, 902} & set(ids) and ids.count(1) == 2
    assert puquality.keep_good(docs.limit(0), labels.limit(0)).count() == 0
    assert puquality.keep_good(docs, labels.limit(0)).count() == docs.count()


def table(spark, x):
    return spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in NAMES))


def test_negative_labels_are_not_used(spark, corpus):
    docs, labels = corpus
    other = docs.join(labels.where("quality = 0").select("doc_id").withColumn("bad", F.lit(True)), "doc_id", "left")
    other = other.withColumn("text", F.when(F.col("bad"), F.lit("wholly other words 1234")).otherwise(F.col("text"))).select(*docs.columns)
    one, two = puquality.train(docs, labels), puquality.train(other, labels)
    assert (one.w1 == two.w1).all() and one.prior == two.prior
    pos, unl = puquality.training_rows(puquality.statistics_table(docs, labels, "doc_id", "text"), 50)
    assert len(pos) == 50 and len(unl) == 50


def test_one_id_in_many_rows_is_one_training_row(spark):
    rows = [(1, f"the same id {i}", 1) for i in range(500)] + [(2, "good text here", 1), (3, "some more text", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, s int")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    pos, unl = puquality.training_rows(puquality.statistics_table(docs, labels, "doc_id", "text"))
    assert (len(pos), len(unl)) == (2, 1)


def _sets(share):
    rng = np.random.default_rng(2)
    p = statistics(pa.array([good(rng) for _ in range(400)]))
    u = statistics(pa.array([good(rng) if rng.random() < share else bad(rng) for _ in range(600)]))
    return p, u


def test_prior_is_counted_over_all_rows(spark):
    p, u = _sets(0.8)
    prior = puquality.estimate_prior(p, u, table(spark, u))
    assert 0.65 < prior < 0.95
    model = puquality._train(p[::2], u[::2], None, 3)
    cuts, scores = np.sort(model.scores(p[1::2])), model.scores(u[1::2])
    assert prior == pytest.approx(puquality.best_bin(cuts, np.array([(scores >= c).mean() for c in cuts]), len(scores)))
    assert puquality.estimate_prior(p, u, table(spark, u).limit(0)) == 0.5


@pytest.mark.parametrize("prior", [None, 0.3, 0.99])
def test_gradient_is_that_of_the_risk(prior):
    rng = np.random.default_rng(0)
    x, is_pos = rng.normal(size=(30, len(NAMES))), np.arange(30) < 12
    theta = [rng.normal(size=(len(NAMES), 4)), rng.normal(size=4), rng.normal(size=4), np.array([0.1])]
    if prior == 0.99:  # positives far above the rest: the second part is below zero
        theta, x = [np.zeros((len(NAMES), 4)), np.zeros(4), np.array([3.0, 0, 0, 0]), np.array([0.0])], x
        theta[0][0, 0] = 1
        x[:, 0] = np.where(is_pos, 2, -2)
    loss, grad, turned = puquality.risk(theta, x, is_pos, prior)
    assert turned == (prior == 0.99)

    def value(t):
        h = np.tanh(x @ t[0] + t[1]) @ t[2] + t[3]
        low, high = np.logaddexp(0, -h), np.logaddexp(0, h)
        if prior is None:
            return low[is_pos].mean() + high[~is_pos].mean()
        rest = high[~is_pos].mean() - prior * high[is_pos].mean()
        return -rest if turned else prior * low[is_pos].mean() + rest

    assert turned or loss == pytest.approx(value(theta))
    for k, part in enumerate(theta):
        for at in np.ndindex(part.shape):
            moved = [t.copy() for t in theta]
            moved[k][at] += 1e-6
            assert (value(moved) - value(theta)) / 1e-6 == pytest.approx(grad[k][at], abs=1e-4)


def test_fit_needs_two_of_each(spark):
    p, u = _sets(0.5)
    model = puquality.fit(p, u, table(spark, u))
    assert (model.scores(p) > 0).mean() > 0.95
    assert puquality.fit(p[:1], u, table(spark, u)) is None


def test_best_condition_is_that_of_all(spark):
    rng = np.random.default_rng(9)
    x = np.round(rng.random((60, len(NAMES))), 1)
    is_bad = (x[:, 3] > 0.55) ^ (rng.random(60) < 0.1)
    gain, condition = rules._best(x, is_bad)
    p0, every = is_bad.sum(), []
    for k, name in enumerate(NAMES):
        values = np.unique(x[:, k])
        for cut in (values[1:] + values[:-1]) / 2:
            for above in (True, False):
                hit = x[:, k] >= cut if above else x[:, k] <= cut
                p = (hit & is_bad).sum()
                every.append(p * (np.log2(p / hit.sum()) - np.log2(p0 / 60)) if p else 0)
    assert gain == pytest.approx(max(every))
    hit = condition.mask(x)
    assert (hit & is_bad).sum() * (np.log2((hit & is_bad).sum() / hit.sum()) - np.log2(p0 / 60)) == pytest.approx(gain)


def test_list_is_as_long_as_the_data_need():
    rng = np.random.default_rng(3)
    x = np.zeros((4000, len(NAMES)))
    x[:, 0] = rng.integers(0, 120, 4000)
    learnt = rules.learn(x, x[:, 0] % 3 == 0)  # forty separate strips, each two conditions
    assert len(learnt) > 32


@pytest.fixture(scope="module")
def tagger():
    rng = np.random.default_rng(1)
    return pii.train(*pii.labelled_windows([good(rng) for _ in range(60)], pii.TRAINING_WINDOWS, 3), seed=0)


def test_crf_loss_is_that_of_all_paths():
    rng = np.random.default_rng(0)
    k, t = len(pii.TAGS), 3
    emit, move = rng.normal(size=(t, 1, k)), rng.normal(size=(k, k))
    gold = np.array([[0], [1], [2]])
    score = lambda path: emit[0, 0, path[0]] + pii._START[path[0]] + sum(emit[i, 0, path[i]] + (move + pii._RULES)[path[i - 1], path[i]] for i in range(1, t))
    every = [score((a, b, c)) for a in range(k) for b in range(k) for c in range(k)]
    loss, demit, dmove = pii.crf_loss(emit, move, gold)
    assert loss == pytest.approx(np.logaddexp.reduce(every) - score((0, 1, 2)))
    step = 1e-5
    moved = emit.copy()
    moved[1, 0, 4] += step
    assert (pii.crf_loss(moved, move, gold)[0] - loss) / step == pytest.approx(demit[1, 0, 4], abs=1e-3)


def planted(seed, n=40):
    """(text, spans): held-out texts with one item of each kind."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(n):
        text, spans = "", set()
        for kind in rng.permutation(pii.KINDS):
            before, item, after = pii._item(rng, str(kind))
            while kind == "CARD" and not pii.luhn("".join(c for c in item if c.isdigit())):
                before, item, after = pii._item(rng, "CARD")
            text += good(rng) + " " + before
            spans.add((len(text), len(text) + len(item), str(kind)))
            text += item + after + " "
        out.append((text, spans))
    return out


def test_held_out_spans(tagger):
    texts = planted(77)
    found = pii.spans(tagger, [t for t, _ in texts])
    hits = sum(len(set(f) & s) for f, (_, s) in zip(found, texts, strict=True))
    assert hits / sum(len(s) for _, s in texts) > 0.85
    assert hits / sum(map(len, found)) > 0.85


#: formats that the training generator does not make
FOREIGN = [
    ("write to j.r.r_tolkien99@sub-domain.archive.museum today", "EMAIL"),
    ("the Office: +44 20 7946 0958, ask", "PHONE"),
    ("ring 555-867-5309 or", "PHONE"),
    ("the host 10.0.0.138, which", "IP"),
    ("paid by 4111-1111-1111-1111 in", "CARD"),
    ("export token='ZmFrZVNlY3JldFZhbHVlRm9yVGVzdGluZ09ubHlYWVo'", "SECRET"),
    ('token = "abcdefghijABCDEFGHIJqrstuvwxyzQRST" and', "SECRET"),
]


def test_foreign_formats(tagger):
    rng = np.random.default_rng(8)
    texts = [good(rng) + " " + t + " " + good(rng) for t, _ in FOREIGN]
    found = [{k for _, _, k in s} for s in pii.spans(tagger, texts)]
    assert sum(k in f for f, (_, k) in zip(found, FOREIGN, strict=True)) >= 6
    plain = [good(rng) for _ in range(300)] + ["the extraordinarily-long-hyphenated-compound and some_long_identifier_name of stone"]
    assert sum(map(len, pii.spans(tagger, plain))) <= 1


def test_tagger_alone(tagger):
    """Precision and recall of the decoded tags themselves, character by character, before spans are settled."""
    hit = told = there = 0
    for text, want in planted(78):
        gold = np.zeros(len(text), bool)
        for s, e, _ in want:
            gold[s:e] = True
        tag = np.zeros(len(text), bool)
        for k in range(0, len(text), pii.WINDOW):
            rows, best = tagger.tags(pii.char_ids(text[k : k + pii.WINDOW])[None])
            for b in best:
                tag[k : k + len(b)] = b > 0
        hit, told, there = hit + (tag & gold).sum(), told + tag.sum(), there + gold.sum()
    assert hit / told > 0.85 and hit / there > 0.85


def test_private_edges(spark, tagger):
    text, want = "address 192.168.10.77 answered", (8, 21, "IP")
    rows = [(0, text), (0, text), (None, text), (10, None), (11, ""), (12, "stone " * 30000 + text), (13, "nothing here but words")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id bigint, text string, kind string")
    got = [(r.doc_id, r.start, r.end, r.kind) for r in pii.find_private(docs, tagger).collect()]
    long_ = tuple(x + 180000 for x in want[:2])
    assert sorted(got, key=str) == sorted([(0, *want), (0, *want), (None, *want), (12, *long_, "IP")], key=str)
    assert pii.find_private(docs.limit(0), tagger).count() == 0


def test_pruned_search_is_the_whole_search(tagger):
    texts = [t for t, _ in planted(5, 20)] + [good(np.random.default_rng(k)) for k in range(60)] + ["9" * 1000, "", "@"]
    assert pii.spans(tagger, texts) == pii.spans(tagger, texts, prune=False)
    ids = np.stack([pii.char_ids(t.ljust(pii.WINDOW)[: pii.WINDOW]) for t in texts])
    rows, best = tagger.tags(ids)
    every, whole = tagger.tags(ids, prune=False)
    assert (np.delete(whole, rows, 0) == 0).all() and (whole[rows] == best).all() and len(rows) < len(every)


def test_fast_pass_is_the_network(tagger):
    ids = np.random.default_rng(0).integers(0, 98, (5, 64)).astype(np.uint8)
    emit, _ = tagger.emissions(ids)
    assert np.allclose((emit[..., 1:] - emit[..., :1]).transpose(0, 2, 1), tagger.advantage(ids), atol=1e-3)


def test_steps_need_no_scalar_functions(tagger, monkeypatch):
    """Of long or short sums, the fast pass takes no tanh or exp, which numpy has one by one on some processors."""
    ids = np.random.default_rng(1).integers(0, 98, (3, 200)).astype(np.uint8)
    wide = pii.Tagger([t * 40 for t in tagger.theta])
    want = [m.emissions(ids)[0] for m in (tagger, wide)]
    monkeypatch.setattr(np, "tanh", None)
    monkeypatch.setattr(np, "exp", None)
    for model, emit in zip((tagger, wide), want, strict=True):
        ahead = (emit[..., 1:] - emit[..., :1]).transpose(0, 2, 1)
        assert np.allclose(ahead, model.advantage(ids), atol=1e-3, rtol=1e-3)


def test_logistic_function():
    x = np.linspace(-400, 400, 80001, dtype=np.float32)
    assert np.abs(pii.logistic(x) - 1 / (1 + np.exp(-x.astype(np.float64).clip(-700, 700)))).max() < 0.0026
    assert (np.diff(pii.logistic(x)) >= 0).all() and np.allclose(pii.logistic(-x), 1 - pii.logistic(x), atol=1e-6)


def test_windows_cover_every_character():
    lengths = np.array([0, 1, pii.WINDOW, pii.WINDOW + 1, 5000])
    text, start, length = pii.windows_of(lengths)
    for k, n in enumerate(lengths):
        seen = np.zeros(n, bool)
        for a, m in zip(start[text == k], length[text == k], strict=True):
            seen[a : a + m] = True
        assert seen.all() and (text == k).any() == (n > 0)


def test_weights_are_saved(spark, tagger, tmp_path):
    tagger.save(spark, f"{tmp_path}/weights")
    again = pii.Tagger.load(spark, f"{tmp_path}/weights")
    assert all((a == b).all() for a, b in zip(tagger.theta, again.theta, strict=True))


def test_training_lends_from_whole_texts(spark):
    docs = spark.createDataFrame([(1, "first " * 3000 + "last " * 3000), (1, "again"), (2, None), (3, " ")], "doc_id bigint, text string")
    seen = []
    real, pii.train = pii.train, lambda *a: seen.append(a)
    try:
        pii.train_on(docs, windows=10)
        pii.train_on(docs.limit(0), windows=10)
    finally:
        pii.train = real
    assert len(seen) == 2 and seen[0][0].shape == (10, pii.TRAIN_WINDOW)
