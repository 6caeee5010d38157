import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from wearlens.llm import kneser, quality
from wearlens.llm.catalog import QUERIES

from . import helpers


class Plain:
    """The same model from its definition."""

    def __init__(self, texts):
        tokens = [[*helpers.spaced(t), None] for t in texts]
        self.count = Counter(w for t in tokens for w in t)
        self.total, self.types = sum(self.count.values()), len(self.count)
        self.pairs = Counter(p for t in tokens for p in zip(["<s>", *t], t, strict=False))
        self.cont = Counter(v for _, v in self.pairs)
        self.follow, self.sums = defaultdict(lambda: [0, 0, 0]), Counter()
        for (u, _), k in self.pairs.items():
            self.follow[u][min(k, 3) - 1] += 1
        for (u, _), k in self.pairs.items():
            self.sums[u] += k
        self.d2, self.d1 = ([0, *kneser.discounts(*(list(c.values()).count(k) for k in (1, 2, 3, 4)))] for c in (self.pairs, self.cont))
        self.spare = sum(self.d1[min(k, 3)] for k in self.cont.values()) / max(1, sum(self.cont.values())) if self.cont else 1.0

    def lower(self, v):
        return (self.cont[v] - self.d1[min(self.cont[v], 3)]) / max(1, sum(self.cont.values())) + self.spare / (self.types + 1)

    def p(self, u, v):
        if not self.sums[u]:
            return self.lower(v)
        left = sum(self.d2[j + 1] * self.follow[u][j] for j in range(3)) / self.sums[u]
        k = self.pairs[(u, v)]
        return (k - self.d2[min(k, 3)]) / self.sums[u] + left * self.lower(v)

    def score(self, text):
        t = [*helpers.spaced(text), None]
        return sum(math.log10(self.p(u, v)) for u, v in zip(["<s>", *t], t, strict=False))

    def base(self, text):
        return sum(math.log10((self.count[w] + 1) / (self.total + self.types + 1)) for w in [*helpers.spaced(text), None])


def sample_texts():
    r = random.Random(4)
    words = ["the", "of", *(f"w{i}" for i in range(40))]
    texts = [" ".join(r.choice(words[: r.choice((4, 42))]) for _ in range(r.randint(0, 40))) for _ in range(60)]
    return [*texts, None, "", "THE Of", "the"]


def test_scores_against_the_definition(spark):
    texts = sample_texts()
    model = kneser.fit(helpers.texts(spark, list(enumerate(texts))))
    plain = Plain(texts)
    assert (model.tokens, model.types) == (plain.total, plain.types)
    asked = [*texts, "unseen words here", "the unseen of"]
    docs = helpers.texts(spark, list(enumerate(asked))).withColumn("lm_score", F.lit("x")).withColumn("keys", F.lit(1))
    for r in kneser.scores(docs, model).collect():
        tokens = [*helpers.spaced(asked[r.doc_id]), None]
        assert (r.n_tokens, r.n_known) == (len(tokens), sum(plain.count[w] > 0 for w in tokens))
        assert r.base_score == pytest.approx(plain.base(asked[r.doc_id])) and r.lm_score == pytest.approx(plain.score(asked[r.doc_id]))


def test_probabilities_sum_to_one():
    plain = Plain(sample_texts())
    for u in ("the", "w3", "<s>"):
        left = sum(plain.d2[j + 1] * plain.follow[u][j] for j in range(3)) / plain.sums[u]
        assert sum(plain.p(u, v) for v in plain.count) + left * plain.spare / (plain.types + 1) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    docs = helpers.texts(spark, [(1, "a b"), (2, None)])
    rows = kneser.scores(docs, kneser.fit(docs.limit(0))).collect()
    assert all(r.lm_score == pytest.approx(0.0) for r in rows)


def test_query_is_better_than_single_words_on_held_out_texts(spark):
    rows = QUERIES["op9_lm_scoring"](spark, helpers.SF).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == 200 and held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_quality_against_the_definition(spark):
    texts = sample_texts()
    docs = helpers.texts(spark, list(enumerate(texts))).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, "en")).withColumn("batch", F.lit("x"))
    trusted = docs.select("text").where("doc_id < 40")
    entries, model = quality.fit(trusted)
    plain = Plain(texts[:40])
    rows = quality.perplexities(docs, entries, model, ["doc_id", "lang"]).collect()
    assert sorted(r.doc_id for r in rows) == list(range(len(texts)))
    for r in rows:
        n = len(helpers.spaced(texts[r.doc_id])) + 1
        assert r.n_tokens == n and r.perplexity == pytest.approx(10 ** (-plain.score(texts[r.doc_id]) / n))


def test_quality_rules_of_thresholds(spark):
    docs = helpers.texts(spark, [(i, "plain words of good text " * 3) for i in range(60)] + [(99, "zq xv ## kk " * 9), (None, None)])
    docs = docs.withColumn("lang", F.when(F.col("doc_id") < 99, "en"))
    labels = spark.createDataFrame([(i, 1) for i in range(60)] + [(99, 0), (None, 1)], "doc_id bigint, quality int")
    rows = {r.doc_id: r for r in quality.classified(docs, labels).collect()}
    assert len(rows) == 62 and all(rows[i].kept for i in range(60)) and not rows[99].kept
    none = quality.classified(docs, labels.limit(0)).collect()
    assert len(none) == 62 and all(r.kept for r in none)
    assert quality.classified(docs.limit(0), labels).count() == 0


def test_quality_query_keeps_most_trusted(spark):
    rows = QUERIES["op6_quality_classifier"](spark, helpers.SF).collect()
    assert len(rows) == 200 and sum(r.kept for r in rows) > 150
