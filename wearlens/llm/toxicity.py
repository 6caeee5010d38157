"""Toxicity: a convolutional text classifier over hashed word embeddings, trained with numpy.

Words (lower-cased, without ASCII punctuation) are looked up in three hashed embedding tables: two by hashes of the whole
word, so that a rare word that shares one slot with an insult still differs in the other, and one by its first PREFIX
bytes, so that unseen forms of a known stem are understood. Filters of several widths slide over the words, the
maximum of each filter over the whole text is taken, and a linear layer gives the logit. Thresholds are set per language on
labelled texts kept out of the fit; the language is read from function words of the text itself. A score is the logistic
of the logit, shifted so that the threshold of the text's language is 0.7.

The fit uses a bounded sample: at most MAX_TOXIC toxic and MAX_CLEAN other labelled texts, taken in the order of a hash of
their id. The thresholds use all labelled texts: histograms of the logits of those that were not fitted, each class weighted
to its number in all labelled texts of the language. Scoring reads every whole text.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textscan import ALNUM, Chunk, Words, give_back, text_chunks

MAX_TOXIC = 5000
MAX_CLEAN = 7000
SLOTS = 18
PREFIX = 4
TABLES = 3
DIM = 8
WIDTHS = (1, 2, 3)
BLANKS = max(WIDTHS)
FILTERS = 8
EPOCHS = 5
CUT = 0.7
FEWEST = 20
BINS = 64
REACH = 32

# Frequent function words per language, by which a text's language is told.
FUNCTION_WORDS = {
    "de": "der die das und ist nicht mit von zu den dem ein eine auf für als auch sich des im",
    "en": "the of and to in is that for it with as was on be by this are from at or",
    "es": "el la los las de que y en un una por con para del se no es al lo como",
    "fr": "le la les des et est que qui dans pour pas sur par une un du avec au ce il",
}
LANGUAGES = (*sorted(FUNCTION_WORDS), "other")


def _language_tables() -> tuple[np.ndarray, np.ndarray]:
    texts = [" ".join(FUNCTION_WORDS[k].split()) for k in LANGUAGES[:-1]]
    words = sorted({w for t in texts for w in t.split()})
    joined = " ".join(words).encode()
    hashes = Words(Chunk(0, np.frombuffer(joined, np.uint8), np.array([0, len(joined)])), ALNUM).hashes()
    order = np.argsort(hashes)
    member = np.array([[w in t.split() for t in texts] for w in words], np.float32)
    return hashes[order], member[order]


_KEYS, _MEMBER = _language_tables()


class TextBatch:
    """Word slots of the documents of a chunk, with blank words after each document, enough for the widest filter."""

    def __init__(self, chunk: Chunk):
        words = Words(chunk, ALNUM)
        hashes = words.hashes()
        self.starts = words.first[:-1] + BLANKS * np.arange(chunk.docs)
        size = len(words) + BLANKS * chunk.docs
        place = np.arange(len(words)) + BLANKS * words.doc()
        self.slots = np.zeros((TABLES, size), np.int32)
        for k, h in enumerate((hashes, hashes >> np.uint64(32), words.hashes(PREFIX))):
            self.slots[k, place] = 1 + (h & np.uint64((1 << SLOTS) - 1)).astype(np.int32) % ((1 << SLOTS) - 1)
        at = np.minimum(np.searchsorted(_KEYS, hashes), len(_KEYS) - 1)
        hit = _KEYS[at] == hashes
        votes = np.zeros((chunk.docs, len(LANGUAGES) - 1), np.float32)
        np.add.at(votes, words.doc()[hit], _MEMBER[at[hit]])
        self.language = np.where(votes.max(1, initial=0) > 0, votes.argmax(1), len(LANGUAGES) - 1)
        self.docs = chunk.docs


class Net:
    """Embeddings, filters and the output layer; Adagrad on the rows that a step touches."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.table = np.empty((TABLES, 1 << SLOTS, DIM), np.float32)
        for part in self.table.reshape(-1, 1 << SLOTS):  # drawn in parts: all at once would be held twice as wide
            part[:] = r.normal(0, 0.1, len(part))
        self.table[:, 0] = 0
        self.seed, self.changed = seed, np.zeros((TABLES, 1 << SLOTS), bool)
        self.filters = [r.normal(0, 0.35, (w, TABLES * DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = r.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.float32(-1)

    def packed(self) -> dict:
        """What the fit has changed: rows of the tables that no step has touched are drawn anew from the seed by `of`."""
        slots = [np.flatnonzero(c).astype(np.int32) for c in self.changed]
        kept = {k: v for k, v in vars(self).items() if k not in ("table", "changed")}
        return kept | {"slots": slots, "rows": [table[s] for table, s in zip(self.table, slots, strict=True)]}

    @classmethod
    def of(cls, weights: dict) -> Net:
        net = cls(weights["seed"])
        for table, changed, slots, rows in zip(net.table, net.changed, weights["slots"], weights["rows"], strict=True):
            table[slots], changed[slots] = rows, True
        vars(net).update((k, v) for k, v in weights.items() if k not in ("slots", "rows"))
        return net

    def embed(self, t: TextBatch) -> np.ndarray:
        return np.concatenate([table[slots] for table, slots in zip(self.table, t.slots, strict=True)], axis=1)

    def pooled(self, t: TextBatch, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Maximum of each filter per document, and where it stands."""
        best, where = [], []
        for f, w in zip(self.filters, WIDTHS, strict=True):
            total = len(x) - w + 1
            response = x[:total] @ f[0]
            for j in range(1, w):
                response += x[j : j + total] @ f[j]
            # a text of fewer words than the width is met by its blanks; no window leaves its document
            top = np.maximum.reduceat(response, t.starts, axis=0)
            if places:
                owner = np.repeat(np.arange(t.docs), np.diff(np.append(t.starts, len(x))))[:total]
                row, col = np.nonzero(response == top[owner])
                at = np.zeros((t.docs, FILTERS), np.int64)
                at[owner[row][::-1], col[::-1]] = row[::-1]
                where.append(at)
            best.append(top)
        return np.concatenate(best, axis=1), np.concatenate(where, axis=1) if places else None

    def logits(self, t: TextBatch) -> np.ndarray:
        top, _ = self.pooled(t, self.embed(t))
        return np.maximum(top + self.shift, 0) @ self.out + self.bias

    def step(self, t: TextBatch, label: np.ndarray, weight: np.ndarray, state: dict, rate: float) -> None:
        x = self.embed(t)
        top, at = self.pooled(t, x, places=True)
        active = np.maximum(top + self.shift, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.bias, -30, 30)))
        delta = ((p - label) * weight / weight.sum()).astype(np.float32)
        to_out, to_bias = active.T @ delta, delta.sum()
        back = np.outer(delta, self.out) * (top + self.shift > 0)
        to_shift, to_filters = back.sum(0), []
        rows, grads = [], []
        for k, (f, w) in enumerate(zip(self.filters, WIDTHS, strict=True)):
            g, a = back[:, k * FILTERS : (k + 1) * FILTERS], at[:, k * FILTERS : (k + 1) * FILTERS]
            change = np.zeros_like(f)
            for j in range(w):
                place = np.minimum(a + j, len(x) - 1)
                change[j] = np.einsum("df,dfe->ef", g, x[place])
                rows.append(place.ravel())
                grads.append((g[:, :, None] * f[j].T[None]).reshape(-1, TABLES * DIM))
            to_filters.append(change)
        rows, grads = np.concatenate(rows), np.concatenate(grads)

        def adagrad(name: str, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
            state[name] = state.get(name, 1e-8) + gradient**2
            return value - rate * gradient / np.sqrt(state[name])

        self.out = adagrad("out", self.out, to_out + 1e-4 * self.out).astype(np.float32)
        self.bias = np.float32(adagrad("bias", self.bias, to_bias))
        self.shift = adagrad("shift", self.shift, to_shift).astype(np.float32)
        self.filters = [adagrad(f"f{k}", f, c).astype(np.float32) for k, (f, c) in enumerate(zip(self.filters, to_filters, strict=True))]
        for half, slots in enumerate(t.slots):
            touched, inverse = np.unique(slots[rows], return_inverse=True)
            total = np.zeros((len(touched), DIM), np.float32)
            np.add.at(total, inverse, grads[:, half * DIM : (half + 1) * DIM])
            total[touched == 0] = 0
            memory = state.setdefault(f"t{half}", np.full((1 << SLOTS, DIM), 1e-8, np.float32))
            memory[touched] += total**2
            self.table[half][touched] -= rate * total / np.sqrt(memory[touched])
            self.changed[half][touched] = True


def _batch(texts: list[str]) -> TextBatch:
    return TextBatch(next(text_chunks(pa.array(texts, pa.string()), 1 << 62)))


def fit(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Weights and the logit threshold per language; a fifth of the texts is kept for the thresholds."""
    held = np.arange(len(texts)) % 5 == 4
    labels = np.asarray(labels, np.float32)
    net, state, r = Net(), {}, np.random.default_rng(11)
    inside = np.flatnonzero(~held)
    share = float(labels[inside].mean()) if len(inside) else 0.5
    for epoch in range(epochs if 0 < share < 1 else 0):
        order = r.permutation(inside)
        for i in range(0, len(order), 64):
            part = order[i : i + 64]
            weight = np.where(labels[part] > 0, 0.5 / share, 0.5 / (1 - share))
            net.step(_batch([texts[j] for j in part]), labels[part], weight, state, 0.1 / (1 + epoch))
    # with few labels the thresholds need all of them
    kept = np.flatnonzero(held) if labels[held].sum() >= FEWEST else np.arange(len(texts))
    parts = [_batch([texts[j] for j in kept[i : i + 64]]) for i in range(0, len(kept), 64)]
    logits = np.concatenate([net.logits(t) for t in parts]) if parts else np.empty(0, np.float32)
    language = np.concatenate([t.language for t in parts]) if parts else np.empty(0, int)
    everywhere = best_cut(logits, labels[kept], 0.0)
    cuts = np.full(len(LANGUAGES), everywhere, np.float32)
    for k in range(len(LANGUAGES)):
        of = language == k
        if labels[kept][of].sum() >= FEWEST:
            cuts[k] = best_cut(logits[of], labels[kept][of], everywhere)
    return {"net": net.packed(), "cuts": cuts, "fitted": np.unique(np.array([_text_key(texts[j]) for j in inside], np.uint64))}


def _text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def best_cut(logits: np.ndarray, labels: np.ndarray, default: float) -> float:
    """The middle of the gap below the cut of the best F1."""
    if not 0 < labels.sum() < len(labels):
        return default
    order = np.argsort(-logits, kind="stable")
    z, y = logits[order].astype(float), labels[order]
    f1 = 2 * np.cumsum(y) / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][z[:-1] == z[1:]] = 0
    best = int(np.argmax(f1))
    return (z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1e-3


def _binned(batches: Iterator[pa.RecordBatch], weights: dict, fitted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Per text its language, the bin of its logit, and whether the text was fitted."""
    net = Net.of(weights)
    for batch in batches:
        for chunk in text_chunks(batch.column("text")):
            t = TextBatch(chunk)
            at = np.round(np.clip(net.logits(t).astype(float), -REACH, REACH) * BINS).astype(np.int32)
            known = np.isin(np.array([xxhash.xxh3_64_intdigest(chunk.text(d)) for d in range(chunk.docs)], np.uint64), fitted)
            ids = batch.column("doc_id")[chunk.first : chunk.first + chunk.docs]
            yield pa.RecordBatch.from_arrays([ids, pa.array(t.language.astype(np.int32)), pa.array(at), pa.array(known)], names=["doc_id", "language", "bin", "fitted"])


def calibrated(documents: DataFrame, labels: DataFrame, model: dict) -> np.ndarray:
    """The logit threshold per language from all labelled texts; `labels` has doc_id and toxic (0, 1).

    The driver gets one row per language, label and bin of the logit: at most 2 * REACH * BINS + 1 bins at any size.
    """
    sent, fitted = model["sent"], model["fitted"]
    kind = documents.schema["doc_id"].dataType.simpleString()
    binned = documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(
        lambda b: _binned(b, sent.value, fitted), f"doc_id {kind}, language int, bin int, fitted boolean"
    )
    found = binned.join(labels.select("doc_id", "toxic"), "doc_id").groupBy("language", "toxic", "bin", "fitted").agg(F.count("*").alias("n")).toPandas()
    cuts = np.asarray(model["cuts"], np.float32).copy()
    everywhere = histogram_cut(found)
    if everywhere is None:
        return cuts
    cuts[:] = everywhere
    for k in range(len(LANGUAGES)):
        of = found[found["language"] == k]
        if of["n"][(of["toxic"] == 1) & ~of["fitted"].astype(bool)].sum() >= FEWEST:
            cuts[k] = everywhere if (own := histogram_cut(of)) is None else own
    return cuts


def histogram_cut(found: pd.DataFrame) -> float | None:
    """The middle of the gap below the bin of the best F1, from (toxic, bin, fitted, n); None without both classes."""
    size = [found["n"][found["toxic"] == c].sum() for c in (0, 1)]
    if not all(size):
        return None
    weighted = []
    for c in (0, 1):
        of = found[found["toxic"] == c]
        fresh = of[~of["fitted"].astype(bool)]
        # with few labels the thresholds need all of them
        used = fresh if fresh["n"].sum() >= FEWEST else of
        weighted.append(used.groupby("bin")["n"].sum() * (size[c] / used["n"].sum()))
    bins = weighted[0].index.union(weighted[1].index).sort_values(ascending=False)
    clean, toxic = (np.cumsum(w.reindex(bins, fill_value=0).to_numpy(float)) for w in weighted)
    best = int(np.argmax(2 * toxic / (toxic + clean + size[1])))
    z = bins.to_numpy(float) / BINS
    return (z[best] + z[best + 1]) / 2 if best + 1 < len(z) else z[best] - 1 / BINS


def _fit_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One task gets the bounded sample; its order is fixed by the text, so a repeated task gives the same weights."""
    rows = pd.concat([b for b in batches if len(b)] or [pd.DataFrame({"text": [], "toxic": [], "place": []})])
    rows = rows.sort_values(["place", "text", "toxic"])
    yield pd.DataFrame({"model": [pickle.dumps(fit(rows["text"].tolist(), rows["toxic"].to_numpy()))]})


def train(documents: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> dict:
    """Fit on a bounded sample of the labelled documents, thresholds from all of them; rows with a null id, text or label are left out.

    The sample is chosen among the labels alone, so that its bounded list of ids can be broadcast and only its texts move.
    """
    rows = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    # an id with several labels is toxic if one of them says so
    rows = rows.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("place", F.xxhash64("doc_id"))
    chosen = [rows.where(F.col("toxic") == value).orderBy("place", "doc_id").limit(most) for value, most in ((1, max_toxic), (0, max_clean))]
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id")
    found = sample.select("text", "toxic", "place").repartition(1).mapInPandas(_fit_rows, "model binary").collect()
    if not found:
        return fit([], np.empty(0))
    model = pickle.loads(found.pop().model)
    # sent once, for the thresholds and for `scores`
    model["sent"] = documents.sparkSession.sparkContext.broadcast(model["net"])
    cuts = calibrated(documents, rows, model)
    give_back()  # the driver goes on to other stages
    return model | {"cuts": cuts}


def scores(documents: DataFrame, model: dict) -> DataFrame:
    """The rows of `documents` (any columns but `toxicity` and `predicted` are kept) with toxicity (0 to 1) and predicted.

    A null or empty text has the score of a text without words. Every text is read whole; equal texts get equal scores.
    """
    sent, cuts = model.get("sent") or documents.sparkSession.sparkContext.broadcast(model["net"]), model["cuts"]
    kept = documents.drop("toxicity", "predicted")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Net.of(sent.value)
        move = np.log(CUT / (1 - CUT))
        for batch in batches:
            for chunk in text_chunks(batch.column("text")):  # rows go on chunk by chunk: whole batches of texts are not held twice
                t = TextBatch(chunk)
                z = net.logits(t).astype(float) - cuts[t.language] + move
                p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
                rows = batch.slice(chunk.first, chunk.docs)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(p, pa.float64()), pa.array((p >= CUT).astype(np.int32))], names=[*batch.schema.names, "toxicity", "predicted"]
                )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(score, f"{schema}, toxicity double, predicted int")
