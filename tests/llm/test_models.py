import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from sitelens.llm import op01_lm_scoring, op02_line_crf, op05_simhash, op07_ranking, op08_mixing

from .conftest import DDL, WORD

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def base(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = set()
    for i in range(len(w) - 2):
        if windows[tuple(w[i:i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_line_counts(docs, rows):
    got = {r.doc_id: r for r in op02_line_crf.label_lines(docs, op02_line_crf.Field.neutral()).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r, want = got[i], base(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    field = op02_line_crf.Field(rng.normal(size=(2, op02_line_crf.N_LINE + 1)), rng.normal(size=(2, 2)))
    row = np.repeat([0, 2, 3], [5, 1, 7])
    x = rng.normal(size=(len(row), op02_line_crf.N_LINE))
    got, emit = field.decode(x, row, 4), field.emissions(x)
    for r in (0, 2, 3):
        at = np.flatnonzero(row == r)
        paths = [[b >> i & 1 for i in range(len(at))] for b in range(1 << len(at))]
        best = max(paths, key=lambda p: sum(emit[a, s] for a, s in zip(at, p)) + sum(field.moves[s, t] for s, t in zip(p, p[1:])))
        assert got[at].tolist() == best


def test_field_separates_labels(tables):
    docs, labels = tables
    got = op02_line_crf.label_lines(docs, op02_line_crf.train(docs, labels)).join(labels, "doc_id").where("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 and got[got.quality == 0].kept.mean() < 0.1


def test_field_is_the_most_likely_one():
    """At the fitted weights no direction raises the likelihood, summed over all label paths one by one."""
    rng = np.random.default_rng(5)
    n, decay = op02_line_crf.N_LINE, 1e-2
    chains = [rng.normal(size=(k, n)) for k in (1, 4, 2, 5, 3, 4)]
    labels = [1, 0, 0, 1, 1, 0]
    share = {y: 0.5 * len(labels) / labels.count(y) for y in (0, 1)}
    size = sum(share[y] * len(c) for c, y in zip(chains, labels))

    def objective(theta):
        field = op02_line_crf.Field(theta[:2 * (n + 1)].reshape(2, n + 1), theta[2 * (n + 1):].reshape(2, 2))
        total = 0.0
        for c, y in zip(chains, labels):
            emit = field.emissions(c)

            def weight(path):
                return sum(emit[a, v] for a, v in enumerate(path)) + sum(field.moves[v, w] for v, w in zip(path, path[1:]))

            paths = [[b >> a & 1 for a in range(len(c))] for b in range(1 << len(c))]
            total += share[y] * (weight([y] * len(c)) - math.log(sum(math.exp(weight(q)) for q in paths)))
        return total / size - decay / 2 * float(theta @ theta)

    field = op02_line_crf.fit(chains, labels, steps=3000, rate=0.02, decay=decay)
    theta = np.concatenate([field.weights.ravel(), field.moves.ravel()])
    for j in range(len(theta)):
        step = np.zeros(len(theta))
        step[j] = 1e-4
        assert abs(objective(theta + step) - objective(theta - step)) / 2e-4 < 1e-3


def test_long_texts_are_fitted(spark):
    """Texts of more than 20,000 characters, and of one line, reach the training."""
    rng = random.Random(4)
    good = "\n".join(" ".join(rng.choice(("river", "stone", "walks", "slowly", "home")) for _ in range(12)) + "." for _ in range(600))
    poor = "\n".join("BUY NOW!!! $$$ 100% | FREE | CLICK" for _ in range(900))
    docs = spark.createDataFrame([(1, good), (2, poor), (3, None), (4, ""), (5, "one " * 9000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (4, 1), (5, 1)], "doc_id long, quality int")
    field = op02_line_crf.train(docs, labels)
    assert np.abs(field.weights).max() > 0.1
    mixed = good[:4000].rsplit("\n", 1)[0] + "\n" + poor[:3500].rsplit("\n", 1)[0]
    marks = [m for _, _, m in op02_line_crf.decode_text(mixed, field)]
    want = ["!!!" not in line for line in mixed.split("\n")]
    assert len(marks) == len(want) and np.mean(np.array(marks) == want) > 0.95
    few = op02_line_crf.train(docs, labels, max_chains=3)
    assert np.isfinite(few.weights).all()


def test_ranking_against_plain_steps():
    """Weights are those of plain gradient steps over the same pairs; as many scores are below 0.5 as labels are poor."""
    rng = np.random.default_rng(6)
    y = (rng.random(120) < 0.7).astype(int)
    x = rng.normal(size=(120, op07_ranking.N_TEXT)) + 0.6 * y[:, None]
    model = op07_ranking.fit(x, y, pairs=400, l2=1e-2, seed=3)
    z = (x - x.mean(0)) / np.maximum(x.std(0), 1e-3)
    draw = np.random.default_rng(3)
    better = draw.choice(np.flatnonzero(y == 1), 400)
    pairs = list(zip(better, draw.choice(np.flatnonzero(y == 0), 400)))
    w = np.zeros(x.shape[1])
    for _ in range(4000):
        grad = -1e-2 * w
        d = np.array([z[a] - z[b] for a, b in pairs])
        grad += (d / (1 + np.exp(d @ w))[:, None]).mean(0)
        w += 0.3 * grad
    assert np.allclose(model.weights, w, atol=1e-3)
    score = model.score(x)
    assert (score < 0.5).sum() == (y == 0).sum()
    u = z @ w - np.sort(z @ w)[(y == 0).sum() - 1:(y == 0).sum() + 1].mean()
    assert np.allclose(score, 1 / (1 + np.exp(-u)), atol=1e-2)


def test_score_of_each_text_alone(spark, tables):
    """The query's scores are those of each text counted by itself."""
    docs, labels = tables
    some = docs.where("doc_id % 50 = 0")
    model = op07_ranking.train(docs, labels)
    got = {r.doc_id: r.score for r in op07_ranking.score(some, model).collect()}
    for r in some.collect():
        text = (r.text or "").encode()
        alone = op07_ranking.Counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
        assert got[r.doc_id] == pytest.approx(float(model.score(alone.text_features())[0]), abs=1e-9)


def test_ranking(tables):
    docs, labels = tables
    got = op07_ranking.rank(docs, labels).toPandas()
    assert len(got) == docs.count() and got.score.between(0, 1).all()
    assert all(h == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(got.doc_id, got.held_out))
    test = got.merge(labels.toPandas(), on="doc_id").query("held_out")
    assert (test.predicted == test.quality).mean() > 0.97
    # held-out labels have no influence
    other = labels.withColumn("quality", op07_ranking.F.when(op07_ranking.held_out("doc_id"), 1 - op07_ranking.F.col("quality")).otherwise(op07_ranking.F.col("quality")))
    again = op07_ranking.rank(docs, other).toPandas()
    assert np.allclose(got.sort_values("doc_id").score, again.sort_values("doc_id").score)


def test_model_cases(odd, empty, docs, rows, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in op07_ranking.rank(odd, none).collect()} == {0.5}
    assert op07_ranking.rank(empty, none).count() == 0
    model = op07_ranking.train(docs, none)
    kept = op07_ranking.accepted(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows)
    assert op02_line_crf.label_lines(odd, op02_line_crf.train(odd, none)).count() == 7
    assert op01_lm_scoring.cross_entropy_difference(empty, empty).count() == 0
    assert op01_lm_scoring.cross_entropy_difference(odd, empty).count() == 7
    mixed = op08_mixing.mixed(docs, op08_mixing.domain_labels(none), {"good": 1.0}, least=1)
    assert mixed.columns == docs.columns and mixed.count() == len(rows)
    assert op08_mixing.mixed(empty, op08_mixing.domain_labels(none), {"good": 1.0}).count() == 0


def test_scores_are_the_model(spark):
    """Against plain bigram models; every word and pair is frequent here."""
    rng = random.Random(1)
    names = ["a", "b", "c", "d"]
    back = [(i, " ".join(rng.choice(names) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    near = [(i, " ".join(rng.choice("ab") for _ in range(9))) for i in range(6)]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DDL)
    got = {r.doc_id: r.score for r in op01_lm_scoring.cross_entropy_difference(frame(back), frame(near)).collect()}

    def counts(rows):
        pairs = Counter(p for _, t in rows for p in zip(["^", *t.split()], t.split()))
        token, context = Counter(), Counter()
        for (v, w), n in pairs.items():
            token[w] += n
            context[v] += n
        return pairs, token, context

    b, t = counts(back), counts(near)
    size, scale = len(set(b[1]) | set(t[1])), sum(t[1].values()) / sum(b[1].values())

    def p(c, by, v, w):
        one = (c[1][w] * by + 8 / size) / (sum(c[1].values()) * by + 8)
        return math.log((c[0][v, w] * by + 8 * one) / (c[2][v] * by + 8))

    for i, text in back:
        words = text.split()
        gains = [p(t, 1, v, w) - p(b, scale, v, w) for v, w in zip(["^", *words], words)]
        assert abs(got[i] - (sum(gains) / len(gains) if gains else 0)) < 1e-9


def test_mixing_meets_reachable_targets(tables):
    docs, labels = tables
    got = op08_mixing.mix(docs, op08_mixing.domain_labels(labels), {"good": 0.8, "poor": 0.15, "toxic": 0.05}).toPandas()
    p, n, rate = np.stack(got.p), got.n_tokens.to_numpy(), got.rate.to_numpy()
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all()
    shares = (p * (n * rate)[:, None]).sum(0) / n.sum()
    assert np.abs(shares - [0.8, 0.15, 0.05]).max() < 0.01


def test_projected_gradient_reaches_the_optimum():
    """The steps of the operator against many plain steps on one machine."""
    rng = np.random.default_rng(3)
    p = rng.dirichlet([1, 1, 1], 300)
    n, target, mu = rng.integers(1, 50, 300).astype(float), np.array([0.6, 0.3, 0.1]), 1e-2
    share = n / n.sum()
    gram = (p * share[:, None]).T @ p
    weight, eta = np.linalg.inv(gram), 1 / (1 + mu)
    history = []
    for _ in range(300):
        _, point = op08_mixing.descend(p, history, eta, mu)
        history.append(weight @ ((share * point) @ p - target))
    rate = np.ones(300)
    for _ in range(20000):
        rate = np.maximum(0, rate - eta * (p @ (weight @ ((share * rate) @ p - target)) + mu * (rate - 1)))
    assert np.abs(op08_mixing.descend(p, history, eta, mu)[0] - rate).max() < 1e-2


def test_every_word_and_pair_keeps_its_counts(spark):
    """Rare words and pairs count as themselves, whatever way the shares send them; an own background too."""
    rng = random.Random(4)
    names = [f"w{i}" for i in range(400)]
    text = lambda: " ".join(names[min(int(rng.paretovariate(0.6)), 399)] for _ in range(rng.randrange(0, 60)))
    docs, back, near = ([(i, text()) for i in range(n)] for n in (80, 120, 10))
    docs += [(500, docs[3][1]), (None, docs[3][1]), (501, None), (502, "w399 once once w399")]
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DDL).repartition(3)

    def counts(rows):
        pairs, token, context = Counter(), Counter(), Counter()
        for _, t in rows:
            for v, w in zip(["^", *(t or "").split()], (t or "").split()):
                pairs[v, w] += 1
                token[w] += 1
                context[v] += 1
        return pairs, token, context

    def want(background):
        b, t = counts(background), counts(near)
        size, scale = len(set(b[1]) | set(t[1])), sum(t[1].values()) / sum(b[1].values())

        def p(c, by, v, w):
            one = (c[1][w] * by + 8 / size) / (sum(c[1].values()) * by + 8)
            return math.log((c[0][v, w] * by + 8 * one) / (c[2][v] * by + 8))

        out = []
        for i, x in docs:
            ws = (x or "").split()
            gains = [p(t, 1, v, w) - p(b, scale, v, w) for v, w in zip(["^", *ws], ws)]
            out.append((-1 if i is None else i, len(ws), sum(gains) / max(len(gains), 1)))
        return sorted(out)

    for background in (None, back):
        expected = want(background or docs)
        for shares in ((2e-6, 2e-6, 1e-4), (2.0, 2.0, 2.0), (0.02, 0.01, 0.05)):
            got = op01_lm_scoring.cross_entropy_difference(frame(docs), frame(near), background and frame(background), *shares).collect()
            got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score) for r in got)
            assert [g[:2] for g in got] == [e[:2] for e in expected]
            assert max(abs(g[2] - e[2]) for g, e in zip(got, expected)) < 1e-9


def test_rare_words_of_the_target_stay_themselves(spark):
    """By default, in a corpus where one occurrence is far below any share: q1x is a target word, q2x is not."""
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DDL)
    docs = [(i, "a b " * 2500) for i in range(60)] + [(100, "a q1x b"), (101, "a q2x b")]
    got = {r.doc_id: r.score for r in op01_lm_scoring.cross_entropy_difference(frame(docs), frame([(0, "a q1x b q1x")])).collect()}
    assert got[100] > got[101] + 1e-6


def test_very_long_texts(spark):
    """One text of three million characters among short ones: same counts and scores as counted alone."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    long = "".join(rng.choice(words) + ("\n" if rng.random() < 0.1 else " ") for _ in range(550_000))
    docs = spark.createDataFrame([(0, "short one"), (1, long), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in op02_line_crf.label_lines(docs, op02_line_crf.Field.neutral()).collect()}
    assert got[1].n_words == 550_000 and got[1].word_chars == sum(map(len, long.split())) and got[2].n_words == 0
    model = op07_ranking.Ranking(np.zeros(op07_ranking.N_TEXT), np.ones(op07_ranking.N_TEXT), np.linspace(-1, 1, op07_ranking.N_TEXT), 0.0)
    text = np.frombuffer(long.encode(), np.uint8)
    alone = model.score(op07_ranking.Counts(text, np.array([0, len(text)])).text_features())[0]
    assert {r.doc_id: r.score for r in op07_ranking.score(docs, model).collect()}[1] == pytest.approx(float(alone))
    prints = {r.doc_id: r for r in op05_simhash.fingerprint_table(docs).collect()}
    own = op05_simhash.fingerprints(text, np.array([0, len(text)])).view(">i8")[0]
    assert [prints[1][p] for p in op05_simhash.PARTS] == own.tolist()
