"""Personal data: candidate spans from generators, accepted by boosted trees.

The base rules (`base_spans`) are always kept. Further generators of high recall propose overlapping spans: written-out
e-mail addresses, national telephone numbers, numbers in card groups with other separators, IPv6 addresses. Boosted trees
over format and context features give each a probability; a span is added if it reaches the threshold of its kind and does
not overlap a span that is already taken.

There are no labelled spans, so the trees learn from weak labels: matches of the base patterns by their checks, proposals by
a check of their plain form (an address once "(at)" and "(dot)" are replaced, the checksum, a valid version 6 address, a word
for a telephone before the number). They are fitted on at most MAX_TEXTS distinct texts, the same number for each kind. The
thresholds come from the scores of the proposals of all texts.
"""

from __future__ import annotations

import ipaddress
import pickle
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import text_chunks

KINDS = ("email", "ip", "card", "phone")
MAX_TEXTS = 4000
LOOKED = 16
ROUNDS, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PRECISION = 0.95
SCORE_BINS = 1000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number starts where its run of digits starts: a later start in the same run meets the same continuation.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = re.compile(r" ?(?:\(at\)|\[at\]|\{at\}|&#64;) ?| at ", re.IGNORECASE)
SPOKEN = re.compile(r"[A-Za-z0-9-]{1,63}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]{1,63}){1,6}", re.IGNORECASE)
DOT = re.compile(r" ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot ", re.IGNORECASE)
NATIONAL = re.compile(r"(?<![0-9])(?:\([0-9]{2,5}\)|0?[0-9]{2,5})[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,4}){1,4}")
GROUPS = re.compile(r"(?<![0-9])[0-9]{4}(?:[ ./_-]{1,2}[0-9]{2,6}){2,4}")
COLONS = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")

# Words before a span that name its kind, per kind and language.
CUES = {
    "email": ("mail", "email", "e-mail", "correo", "courriel", "contact"),
    "ip": ("ip", "host", "server", "address", "adresse"),
    "card": ("card", "visa", "karte", "carte", "tarjeta", "credit"),
    "phone": ("phone", "tel", "call", "telefon", "fax", "mobile", "llamar"),
}

# What a text must show to be of use for learning a kind: one of some strings, or a pattern.
HINTS = {"email": ("@", "(at)", "[at]", "{at}", " dot ", "&#64;"), "ip": r"[0-9]\.[0-9]+\.[0-9]|:[0-9A-Fa-f]{0,4}:", "card": r"[0-9]{4}[ ./_-]?[0-9]{4}", "phone": r"\+[0-9]|[0-9)][ ./-][0-9]"}


def hinted_at(kind: str) -> Column:
    hint = HINTS[kind]
    return F.col("text").rlike(hint) if isinstance(hint, str) else reduce(or_, (F.contains("text", F.lit(h)) for h in hint))


def passes_luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else 2 * v - 9 * (v > 4)
    return total % 10 == 0


def at_most_255(part: str) -> bool:
    """Whether a run of digits, leading zeros or not, is a number up to 255."""
    number = part.lstrip("0")
    return len(number) < 3 or (len(number) == 3 and number <= "255")


def matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, passes) of the base patterns' matches, leftmost and non-overlapping per kind."""
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end(), True))
            low = m.end()
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        out.append((m.start(), 1, m.end(), all(at_most_255(p) for p in m[0].split("."))))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            out.append((m.start(), 2, m.end(), 14 <= len(digits) <= 19 and passes_luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            out.append((m.start(), 3, m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15))
    return sorted(out)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    return [(s, k, e) for s, k, e, good in matches(text) if good]


def proposals(text: str) -> list[tuple[int, int, int]]:
    """Spans of the generators of high recall; they may overlap each other and the base spans."""
    out, low = [], text.lower()
    if "dot" in low or "(at)" in low or "[at]" in low or "{at}" in low or "&#64;" in low:
        for m in AT.finditer(text):
            start = m.start()
            while start > 0 and m.start() - start < 64 and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start() and (d := SPOKEN.match(text, m.end())):
                out.append((start, 0, d.end()))
    if text.count(":") > 2:
        out += [(m.start(), 1, m.end()) for m in COLONS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in GROUPS.finditer(text)]
    out += [(m.start(), 3, m.end()) for m in NATIONAL.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start : min(end, start + 200)]
    digits = "".join(c for c in span if "0" <= c <= "9")
    groups = re.findall(r"[0-9]+", span)
    around = text[max(0, start - 40) : start].lower()
    before, after = text[start - 1 : start], text[end : end + 1]
    numbers = [int(g) for g in groups if len(g) < 10]
    return [
        *(float(kind == k) for k in range(4)),
        min(end - start, 200), len(digits), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(span[:1] == "+"), span.count("("), span.count("."), span.count(" "), span.count("-"), span.count("/"), span.count(":"),
        float(len(digits) > 1 and passes_luhn(digits)), max(numbers, default=0), len(set(digits)),
        float(before.isalnum()), float(after.isalnum()), float("@" in span), sum(c.isalpha() for c in span),
        float(any(w in around for w in CUES[KINDS[kind]])), sum("0" <= c <= "9" for c in around),
    ]


class Boosted:
    """Trees of fixed depth on quantile bins, logistic loss; one threshold per kind. Without trees, or for a kind without a threshold,
    no span is taken."""

    def __init__(self) -> None:
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.start, self.cuts = -2.0, np.full(len(KINDS), np.inf)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        b, z = self.bins(x), np.full(len(y), self.start)
        for _ in range(ROUNDS):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            node, inner = np.zeros(len(y), int), 2**DEPTH - 1
            split, cut = np.zeros(inner, int), np.full(inner, BINS + 1)
            for level in range(DEPTH):
                first = 2**level - 1
                for n in range(first, first + 2**level):
                    rows = np.flatnonzero(node == n)
                    best = 1e-6
                    for j in range(b.shape[1]) if len(rows) > 1 else ():
                        sg = np.cumsum(np.bincount(b[rows, j], g[rows], BINS + 1))
                        sh = np.cumsum(np.bincount(b[rows, j], h[rows], BINS + 1))
                        gain = sg**2 / (sh + 1) + (sg[-1] - sg) ** 2 / (sh[-1] - sh + 1) - sg[-1] ** 2 / (sh[-1] + 1)
                        k = int(np.argmax(gain))
                        if gain[k] > best:
                            best, split[n], cut[n] = gain[k], j, k
                    node[rows] = 2 * n + 1 + (b[rows, split[n]] > cut[n])
            leaf = node - inner
            value = RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + 1)
            self.trees.append((split, cut, value))
            z += value[leaf]
        return self

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        b = self.bins(x) if self.edges else None
        for split, cut, value in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (b[np.arange(len(x)), split[node]] > cut[node])
            z += value[node - (2**DEPTH - 1)]
        return 1 / (1 + np.exp(-z))


def free_proposals(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The proposals that the trees decide: those that meet no base span."""
    return [(s, k, e) for s, k, e in proposals(text) if not any(s < e2 and s2 < e for s2, _, e2 in base)]


def plausible(text: str, start: int, kind: int, end: int) -> bool:
    """The weak label of a proposal: whether its plain form passes a check of its kind."""
    if text[start - 1 : start].isalnum() or text[end : end + 1].isalnum():
        return False
    span = text[start:end]
    if kind == 0:
        plain = DOT.sub(".", AT.sub("@", span))
        return " " not in plain and plain[-1].isalpha() and bool(base_spans(plain))
    if kind == 1:
        try:
            return ipaddress.ip_address(span).version == 6
        except ValueError:
            return False
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 2:
        return 14 <= len(digits) <= 19 and passes_luhn(digits)
    around = text[max(0, start - 40) : start].lower()
    return 8 <= len(digits) <= 15 and any(w in around for w in CUES["phone"])


def weak_labels(text: str) -> list[tuple[list[float], float]]:
    found = matches(text)
    base = [(s, k, e) for s, k, e, good in found if good]
    rows = [(features(text, s, k, e), float(good)) for s, k, e, good in found]
    return rows + [(features(text, s, k, e), float(plausible(text, s, k, e))) for s, k, e in free_proposals(text, base)]


def fit(texts: list[str]) -> Boosted:
    rows = [r for t in texts for r in weak_labels(t)]
    y = np.array([r[1] for r in rows])
    if not 0 < y.sum() < len(y):
        return Boosted()
    return Boosted().fit(np.array([r[0] for r in rows], float), y)


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    texts = sorted(t for b in batches for t in b["text"])
    yield pd.DataFrame({"model": [pickle.dumps(vars(fit(texts)))]})


def sample_texts(documents: DataFrame, max_texts: int = MAX_TEXTS) -> DataFrame:
    """Distinct texts for the fit, at most max_texts: the same number for each kind, among the texts that could hold it.

    Hashes of the texts are chosen first; they are few, so they are broadcast and only their texts move. Copies count once.
    """
    texts = documents.select("text", F.xxhash64("text").alias("place")).where("text is not null")
    # looked at: about LOOKED texts for each that is taken, by their hashes; all of them where there are no more
    share = min(1.0, LOOKED * max_texts / max(1, documents.count()))
    thinned = texts.where(F.pmod("place", F.lit(1 << 20)) < F.lit(max(1, int(share * (1 << 20)))))
    hints = [F.when(hinted_at(kind), F.lit(kind)) for kind in KINDS]
    hinted = thinned.select("place", F.explode(F.array_compact(F.array(*hints))).alias("kind")).distinct()
    chosen = [hinted.where(F.col("kind") == kind).orderBy("place").limit(max_texts // len(KINDS)).select("place") for kind in KINDS]
    places = F.broadcast(reduce(DataFrame.unionAll, chosen).distinct())
    return texts.join(places, "place").groupBy("place").agg(F.min("text").alias("text")).select("text")


def _histogram(batches: Iterator[pa.RecordBatch], model: Boosted) -> Iterator[pa.RecordBatch]:
    """Free proposals by kind, bin of the score and weak label, counted per batch."""
    for batch in batches:
        counts: Counter = Counter()
        for chunk in text_chunks(batch.column("text")):
            rows, kinds, labels = [], [], []
            for t in batch.column("text")[chunk.first : chunk.first + chunk.docs].to_pylist():
                for s, k, e in free_proposals(t, base_spans(t)) if t else ():
                    rows.append(features(t, s, k, e))
                    kinds.append(k)
                    labels.append(int(plausible(t, s, k, e)))
            if rows:
                bins = np.minimum((model.probability(np.array(rows, float)) * SCORE_BINS).astype(int), SCORE_BINS - 1)
                counts.update(zip(kinds, bins.tolist(), labels, strict=True))
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), pa.array([counts[k] for k in keys], pa.int64())], names=["kind", "bin", "label", "n"]
        )


def cuts_of(counts: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Per kind the lowest score of at least 0.5 from which on the precision is PRECISION, from (kind, bin, label, n); a kind that
    reaches it nowhere adds nothing."""
    table = np.zeros((len(KINDS), SCORE_BINS, 2))
    for k, b, y, n in counts:
        table[k, b, y] += n
    cuts = np.full(len(KINDS), np.inf)
    for k in range(len(KINDS)):
        above = np.cumsum(table[k, ::-1], axis=0)[::-1]
        total = above.sum(1)
        good = np.flatnonzero((total > 0) & (above[:, 1] >= PRECISION * total) & (np.arange(SCORE_BINS) >= SCORE_BINS // 2))
        if len(good):
            cuts[k] = good[0] / SCORE_BINS
    return cuts


def train(documents: DataFrame, max_texts: int = MAX_TEXTS) -> Boosted:
    """Trees from a bounded sample of distinct texts, thresholds from the free proposals of all texts.

    The driver gets one row per kind, bin and label. Where no text has a match or proposal the model adds nothing.
    """
    found = sample_texts(documents, max_texts).coalesce(1).mapInPandas(_fit_rows, "model binary").collect()
    model = Boosted()
    vars(model).update(pickle.loads(found[0].model) if found else {})
    if model.trees:
        sent = documents.sparkSession.sparkContext.broadcast(model)
        counted = documents.select("text").mapInArrow(lambda b: _histogram(b, sent.value), "kind int, bin int, label int, n bigint")
        model.cuts = cuts_of([tuple(r) for r in counted.groupBy("kind", "bin", "label").agg(F.sum("n")).collect()])
    return model


def find(texts: list[str], model: Boosted) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """Base spans, and all spans, of each text."""
    base = [base_spans(t) for t in texts]
    asked = []
    for i, t in enumerate(texts):
        asked += [(i, s, k, e) for s, k, e in free_proposals(t, base[i])]
    extra: dict[int, list] = {}
    if asked:
        p = model.probability(np.array([features(texts[i], s, k, e) for i, s, k, e in asked], float))
        taken = sorted((-q, i, s, k, e) for q, (i, s, k, e) in zip(p.tolist(), asked, strict=True) if q >= model.cuts[k])
        for _, i, s, k, e in taken:
            if not any(s < e2 and s2 < e for s2, _, e2 in extra.get(i, ())):
                extra.setdefault(i, []).append((s, k, e))
    return [(b, sorted(b + extra[i]) if i in extra else b) for i, b in enumerate(base)]


def written_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with a mark in place of each span; overlapping spans become one mark of the first one's kind."""
    out, low = [], 0
    for s, k, e in spans:
        if s >= low:
            out += [text[low:s], f"<{KINDS[k].upper()}>"]
        low = max(low, e)
    return "".join([*out, text[low:]])


def private_spans(documents: DataFrame, model: Boosted | None = None) -> DataFrame:
    """The rows of `documents` with `base` and `spans` (arrays of kind, start, end in code points) and `redacted`.

    A null text is empty and has no spans; repeated rows are treated alike. Columns base, spans and redacted of the input
    are replaced; all other columns are kept and not read.
    """
    sent = documents.sparkSession.sparkContext.broadcast(model or train(documents))
    kept = documents.drop("base", "spans", "redacted")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):  # rows go on chunk by chunk: whole batches of texts are not held twice
                rows = batch.slice(chunk.first, chunk.docs)
                texts = [t or "" for t in rows.column("text").to_pylist()]
                found = find(texts, sent.value)
                lists = [[[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in part] for part in side] for side in zip(*found, strict=True)]
                clean = [redacted(t, spans) for t, (_, spans) in zip(texts, found, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, *(pa.array(x, kind) for x in lists), pa.array(clean, pa.string())], names=[*batch.schema.names, "base", "spans", "redacted"]
                )

    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(scan, f"{schema}, base {spans}, spans {spans}, redacted string")
