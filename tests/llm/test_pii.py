import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wearlens.llm import pii
from wearlens.llm.catalog import QUERIES

from . import helpers


def plain_spans(t):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[ -]", "", m[0])
        if 14 <= len(digits) <= 19 and pii.passes_luhn(digits):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a019.@+- ()x2é%", max_size=45))
def test_base_spans(text):
    assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_known_kinds():
    text = "mail a.b@mail1.example.com, 10.0.0.300 10.0.0.3, card 4111 1111 1111 1111 or +1 (743) 555-3824."
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans(text)] == ["email", "ip", "card", "phone"]
    assert pii.redacted(text, pii.base_spans(text)) == "mail <EMAIL>, 10.0.0.300 <IP>, card <CARD> or <PHONE>."


def test_address_parts_may_have_any_leading_zeros():
    for zeros in (1, 299, 300, 4000):
        for number, good in (("255", True), ("256", False), ("0", True), ("1000", False)):
            text = f"10.0.{'0' * zeros}{number}.1"
            assert bool(pii.base_spans(text)) == good == bool(plain_spans(text))


def test_long_texts_take_linear_time():
    for text in ("1" * 200_000, "1." * 100_000, "a" * 200_000 + "@", "+1" * 100_000, "@" * 200_000, "1 " * 100_000):
        assert len(pii.base_spans(text)) <= 1 or text.startswith("1.")


def test_added_spans_and_odd_rows(spark):
    texts = [f"call us +1 (743) 555-38{i:02d} or mail n.{i}@mail.example.com at 10.0.{i}.7, card 4111111111111111 or {i}234567812345678" for i in range(40)]
    rows = [*enumerate(texts), (100, None), (101, ""), (None, "write to jo (at) mail (dot) example (dot) com"), (100, "10.0.0.1")]
    docs = helpers.texts(spark, rows).withColumn("spans", F.lit("x")).withColumn("kind", F.lit(1))
    found = pii.private_spans(docs).collect()
    assert len(found) == len(rows) and all(r.kind == 1 for r in found)
    for r in found:
        spans = [(s.start, pii.KINDS.index(s.kind), s.end) for s in r.base]
        assert spans == plain_spans(r.text or "") and set(map(tuple, r.base)) <= set(map(tuple, r.spans))
    assert pii.private_spans(helpers.texts(spark, [])).count() == 0


def test_trees_add_likely_spans_and_no_others(spark):
    good = [f"note {i}: write to jo{i} (at) mail{i} (dot) example (dot) com today" for i in range(60)]
    cards = [f"card 41111111{i:04d}{d}" for i in range(60) for d in range(1000, 1010)]  # Luhn decides the base; spans with dots are proposals
    dotted = [f"paid {n[5:9]}.{n[9:13]}.{n[13:17]}.{n[17:21]} twice" for n in cards]
    times = [f"log {i} 12:0{i % 10}:11:4{i % 10} went 10:2{i % 10}:59:zz on" for i in range(60)]
    six = [f"host fe80:0:0:{i:x}:1:2:3:4 is up" for i in range(60)]
    calls = [f"phone 030 5{i:03d} {i + 1000}" for i in range(60)] + [f"page 030 5{i:03d} {i + 1000}" for i in range(60)]
    texts = good + cards + dotted + times + six + calls
    docs = helpers.texts(spark, [*enumerate(texts), *((10_000 + i, texts[0]) for i in range(5000))])  # one text with most of the rows
    sampled = [r.text for r in pii.sample_texts(docs, 400).collect()]
    assert len(sampled) == len(set(sampled)) <= 400 and any("(at)" in t for t in sampled) and any("fe80" in t for t in sampled)
    found = {r.doc_id: r for r in pii.private_spans(docs).collect()}
    for i, text in enumerate(texts):
        base, extra = plain_spans(text), [s for s in found[i].spans if s not in found[i].base]
        wanted = [(s, k, e) for s, k, e in pii.free_proposals(text, base) if pii.plausible(text, s, k, e)]
        if text in good or text in six:
            assert wanted and [(s.start, pii.KINDS.index(s.kind), s.end) for s in extra] == wanted
        if text in times or text.startswith("page"):
            assert not extra
    assert "(at)" not in found[0].redacted


def test_thresholds_hold_the_precision():
    cuts = pii.cuts_of([(0, 990, 1, 95), (0, 990, 0, 5), (0, 700, 1, 5), (0, 700, 0, 5), (1, 900, 0, 4), (2, 400, 1, 9), (3, 600, 1, 1)])
    assert cuts.tolist() == [0.701, float("inf"), float("inf"), 0.5]
    assert pii.find(["jo (at) mail (dot) example (dot) com"], pii.Boosted()) == [([], [])]


def test_trees_equal_plain_ones():
    import numpy as np

    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6)).round(1)
    y = ((x[:, 0] > 0.2) & (x[:, 3] < 0.5)).astype(float)
    model = pii.Boosted().fit(x, y)

    def plain(row):
        z = model.start
        for split, cut, value in model.trees:
            node = 0
            for _ in range(pii.DEPTH):
                bin_ = sum(e <= row[split[node]] for e in model.edges[split[node]])
                node = 2 * node + 1 + (bin_ > cut[node])
            z += value[node - (2**pii.DEPTH - 1)]
        return 1 / (1 + np.exp(-z))

    p = model.probability(x)
    assert np.allclose(p, [plain(row) for row in x]) and ((p > 0.5) == (y == 1)).mean() > 0.97


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{helpers.SF}/documents.parquet").collect()}
    rows = QUERIES["op4_pii"](spark, helpers.SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = plain_spans(texts[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(pii.written_spans(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == j for _, k, _ in spans) for j in range(4)]
