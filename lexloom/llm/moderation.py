"""Abusive, hateful or sexual content (p9): subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

Readers label documents, but what they object to is a passage. So documents are cut into passages (sentences and the
parts between commas), a passage's vector is the mean over its words, a word's vector the mean over its own
row and the rows of its character n-grams, and a document scores as its worst passage. Training alternates: passages of
documents labelled 1 start out as suspects, then only those the model itself rates highest stay positive, while
passages that also occur in documents labelled 0 lose out. Equal passages are trained on once, with the weight of all.

Spelling tricks are undone before: accents, digits for letters, dots or blanks between letters.

Labels: a text's label is the mean of the non-null labels of all documents that have it (ties are left out). At most MAX_LABELLED
distinct texts fit the model, the ones with the smallest hashes: a documented bound on labelled rows, 3 MB of text. Copies under other
ids neither use up the bound nor stand on both sides of a fold. FOLDS models are trained side by side as Spark tasks, each without one part of the texts; the model is the mean of them (they are linear once trained), and each scores
the part it has not seen. Then every document is scored, whole, single words too, and the threshold is set from these scores of all
documents: the one with the best F1 if found documents are counted among all and found positives among the held-out ones.

Defined results: null and empty texts score 0; without both kinds of label every document scores 0 and none is found;
equal texts score alike; repeated rows (equal id) are scored alike; extra columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexloom.plans.runtime import materialize

MAX_LABELLED = 3000
FOLDS = 5
#: Share of documents labelled 0 whose worst passage is surely harmless.
USUAL = 0.85
BUCKETS = 1 << 18
DIM = 8
STEPS = 40
ROUNDS = 5
DECAY = 1e-6
RATES = (1.0, 0.1, 0.1)
#: Steps of the score at which all documents are counted.
BINS = 1000

_LEET = str.maketrans("013457@$!|", "oieastasil")
_MIXED = re.compile(r"[a-z0-9@$!|]*[a-z][a-z0-9@$!|]*[0-9@$][a-z0-9@$!|]*|[0-9@$]+[a-z][a-z0-9@$!|]*")
_SPACED = re.compile(r"(?<!\w)(?:\w[ .\-_*]{1,2}){3,}\w(?!\w)")
_DOTTED = re.compile(r"(?<=[a-z])[.*_](?=[a-z])")
_STARS = re.compile(r"(?<=[a-z])\*{2,}(?=[a-z])")
_CUT = re.compile(r"[.!?;:]+(?=\s|$|[\"»”])|[\n\r]+")
_PART = re.compile(r"[,()\[\]\"«»“”„]")
_WORD = re.compile(r"[a-z0-9*@$ß]+")


def clean(text: str) -> str:
    t = text.lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c) and unicodedata.category(c) != "Cf")
    t = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m.group()) if not m.group().replace(" ", "").replace(".", "").isdigit() else m.group(), t)
    t = _STARS.sub("*", t)
    return _DOTTED.sub("", t) if "." in t or "_" in t else t


@lru_cache(maxsize=200_000)
def plain_word(w: str) -> str:
    return w.translate(_LEET) if not w.isalpha() and not w.isdigit() and _MIXED.fullmatch(w) else ("0" if w.isdigit() else w)


def sentences(text: str) -> list[str]:
    return _CUT.split(clean(text))


def sentence_passages(s: str) -> list[list[str]]:
    """The words of a sentence, and of every part of it where it has several."""
    words = [plain_word(w) for w in _WORD.findall(s)]
    if not words:
        return []
    if not _PART.search(s):
        return [words]
    parts = [p for p in ([plain_word(w) for w in _WORD.findall(p)] for p in _PART.split(s)) if p]
    # a short sentence says something as a whole, too
    return [*parts, words] if len(words) <= 16 else parts


def passages(text: str) -> list[list[str]]:
    return [p for s in sentences(text) for p in sentence_passages(s)]


@lru_cache(maxsize=300_000)
def rows_of(token: str) -> tuple[int, ...]:
    """Hash rows of a word: its own and those of its character n-grams of 3 and 4."""
    w = f"<{token}>"
    keys = [token, *(w[i : i + n] for n in (3, 4) for i in range(len(w) - n + 1))]
    return tuple(xxhash.xxh32_intdigest(k) % BUCKETS for k in keys)


class Bags:
    """Distinct passages as index arrays: occurrences of tokens, and rows of tokens. ``of_passage`` and ``of_doc`` say which passage
    stands in which document."""

    def __init__(self, passages_: list[tuple[str, ...]], of_passage: np.ndarray, of_doc: np.ndarray):
        ids: dict[str, int] = {}
        occ, lens = [], []
        for p in passages_:
            lens.append(len(p))
            occ += [ids.setdefault(t, len(ids)) for t in p]
        self.n, self.lens = len(passages_), np.array(lens, np.float32)
        self.occ = np.array(occ, np.int64)
        self.of = np.repeat(np.arange(self.n), lens)
        rows = [rows_of(t) for t in ids]
        self.rlens = np.array([len(r) for r in rows], np.float32)
        flat = np.array([x for r in rows for x in r], np.int64)
        self.used, self.row = np.unique(flat, return_inverse=True)
        self.row_of = np.repeat(np.arange(len(rows)), self.rlens.astype(int))
        self.by_token = np.argsort(self.occ, kind="stable")
        self.token_start = np.searchsorted(self.occ[self.by_token], np.arange(len(ids)))
        self.by_row = np.argsort(self.row, kind="stable")
        self.row_start = np.searchsorted(self.row[self.by_row], np.arange(len(self.used)))
        self.pass_start = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
        self.rstart = np.concatenate([[0], np.cumsum(self.rlens)[:-1]]).astype(np.int64)
        # rows seen in one document only are not trained: they would learn its names by heart
        order = np.argsort(of_passage, kind="stable")
        first = np.searchsorted(of_passage[order], np.arange(self.n + 1))
        seen = np.unique(self.occ * (1 << 32) + self.of)
        token, where = seen >> 32, seen & 0xFFFFFFFF
        docs = first[where + 1] - first[where]
        seen = np.unique(np.repeat(token, docs) * (1 << 32) + of_doc[order][_repeat_ranges(first[where], docs)])
        token, doc = seen >> 32, seen & 0xFFFFFFFF
        count = self.rlens.astype(np.int64)[token]
        pair = np.unique(self.row[_repeat_ranges(self.rstart[token], count)] * (1 << 32) + np.repeat(doc, count))
        self.shared = (np.bincount(pair >> 32, minlength=len(self.used)) > 1).astype(np.float32)[:, None]


def _repeat_ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for every range, one after the other."""
    upto = np.cumsum(count)
    return np.arange(upto[-1] if len(upto) else 0) + np.repeat(start - (upto - count), count)


def train(b: Bags, y: np.ndarray, weight: np.ndarray, start: tuple | None, steps: int, seed: int = 0) -> tuple:
    """Adam on all passages at once; returns (row vectors, class weights, bias)."""
    rng = np.random.default_rng(seed)
    e, w, bias = start if start else (rng.normal(0, 0.3, (len(b.used), DIM)).astype(np.float32) * b.shared, rng.normal(0, 0.3, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32))
    params = [e.copy(), w.copy(), bias.copy()]
    m, v = [np.zeros_like(p) for p in params], [0.0] * len(params)
    target = np.stack([1 - y, y], 1).astype(np.float32)
    weight = (weight / weight.sum()).astype(np.float32)[:, None]
    size = (b.lens + 1)[:, None]
    for t in range(1, steps + 1):
        e, w, bias = params
        token = np.add.reduceat(e[b.row], b.rstart, axis=0) / b.rlens[:, None]
        h = np.add.reduceat(token[b.occ], b.pass_start, axis=0) / size
        z = h @ w + bias
        z -= z.max(1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(1, keepdims=True)
        gz = (p - target) * weight
        gh = (gz @ w.T) / size
        gt = np.add.reduceat(gh[b.of[b.by_token]], b.token_start, axis=0) / b.rlens[:, None]
        ge = np.add.reduceat(gt[b.row_of[b.by_row]], b.row_start, axis=0) * b.shared + DECAY * e
        for k, g in enumerate((ge, h.T @ gz + 1e-4 * w, gz.sum(0))):
            m[k] = 0.9 * m[k] + 0.1 * g
            # one scale for all rows: a rare row moves as little as its passages weigh, else it is learnt by heart
            v[k] = 0.95 * v[k] + 0.05 * float((g * g).sum(1).max() if k == 0 else (g * g).max())
            params[k] = params[k] - RATES[k] * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.95**t)) + 1e-12)
    return tuple(params)


def passage_logits(b: Bags, model: tuple) -> np.ndarray:
    e, w, bias = model
    row = e @ (w[:, 1] - w[:, 0])
    token = np.add.reduceat(row[b.row], b.rstart) / b.rlens
    return np.add.reduceat(token[b.occ], b.pass_start) / (b.lens + 1) + bias[1] - bias[0]


class Model:
    """The trained model reduced to one number per hash row: what a row adds to a passage's log odds."""

    def __init__(self, rows: np.ndarray, bias: float):
        self.rows, self.bias, self.cache, self.said = rows, bias, {}, {}

    def __getstate__(self):
        return {"rows": self.rows, "bias": self.bias, "cache": {}, "said": {}}

    def _token(self, t: str) -> float:
        r = self.cache.get(t)
        if r is None:
            if len(self.cache) > 500_000:
                self.cache.clear()
            r = self.cache[t] = float(np.mean(self.rows[list(rows_of(t))]))
        return r

    def _worst(self, sentence: str) -> tuple[float, list[str] | None]:
        """(log odds, words) of a sentence's worst passage; sentences come again and again, so they are remembered."""
        found = self.said.get(sentence)
        if found is None:
            found = (-np.inf, None)
            for p in sentence_passages(sentence):
                z = sum(map(self._token, p)) / (len(p) + 1) + self.bias
                if z > found[0]:
                    found = (z, p)
            if len(self.said) > 200_000:
                self.said.clear()
            self.said[sentence] = found
        return found

    def score(self, text: str | None) -> tuple[float, str | None]:
        """(probability that the worst passage is abusive, that passage)."""
        worst, said = max((self._worst(s) for s in sentences(text or "")), key=lambda f: f[0], default=(-np.inf, None))
        return (0.0, None) if said is None else (float(1 / (1 + np.exp(-np.clip(worst, -30, 30)))), " ".join(said))


def fit(texts: list[str], labels: list[float], seed: int = 0) -> Model:
    """Multiple-instance training from documents and their mean labels."""
    ids: dict[tuple[str, ...], int] = {}
    uid, doc = [], []
    for d, t in enumerate(texts):
        for p in passages(t):
            uid.append(ids.setdefault(tuple(p), len(ids)))
            doc.append(d)
    uid, doc, y = np.array(uid, np.int64), np.array(doc, np.int64), np.asarray(labels, float) > 0.5
    if not len(uid) or y.all() or not y.any():
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    b = Bags(list(ids), uid, doc)
    bad = y[doc]
    share = 1.0 / np.bincount(doc, minlength=len(texts))[doc]

    def learn(positive: np.ndarray, w: np.ndarray, start: tuple | None) -> tuple:
        """Weights by documents: a harmless document says of each of its passages that it is harmless. A passage's target is the
        weighted mean over its occurrences."""
        each = np.zeros(len(w))
        for group in (positive, ~positive):
            each[group] = w[group] / max(1, len(np.unique(doc[group])))
        whole = np.bincount(uid, each, minlength=b.n)
        return train(b, np.bincount(uid, np.where(positive, each, 0.0), minlength=b.n) / whole, whole, start, STEPS, seed)

    model = learn(bad, share, None)
    for _ in range(ROUNDS):
        z = passage_logits(b, model)[uid]
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, doc, z)
        # in a document labelled 1: passages that are worse than the worst ones of most documents labelled 0 (readers err, so
        # some documents have none); the rest counts as harmless, but less surely
        usual = best[~y & np.isfinite(best)]
        least = max(0.0, float(np.quantile(usual, USUAL))) if len(usual) else 0.0
        chosen = bad & (z >= least) & (z >= 0.5 * best[doc])
        if not chosen.any():
            break
        model = learn(chosen, np.where(bad & ~chosen, 0.3, 1.0), model)
    e, w, bias = model
    rows = np.zeros(BUCKETS, np.float32)
    rows[b.used] = e @ (w[:, 1] - w[:, 0])
    return Model(rows, float(bias[1] - bias[0]))


class Fitted(NamedTuple):
    """The mean model, and held-out scores and labels of the documents it was fitted on."""

    model: Model
    scores: np.ndarray
    labels: np.ndarray


def _fit_fold(t: pa.Table) -> pa.Table:
    """One model, trained without the documents of its fold, and the scores of those."""
    fold = t["fold"][0].as_py()
    rows = sorted(zip(t["body"].to_pylist(), t["y"].to_pylist(), t["part"].to_pylist(), strict=True), key=lambda r: (xxhash.xxh64_intdigest(r[0].encode("utf-8", "surrogatepass")), r[0]))
    seen = [r for r in rows if r[2] != fold]
    model = fit([r[0] for r in seen], [r[1] for r in seen])
    held = [r for r in rows if r[2] == fold]
    return pa.table(
        {
            "rows": pa.array([model.rows.astype(np.float32).tobytes()], pa.binary()),
            "bias": pa.array([model.bias], pa.float64()),
            "scores": pa.array([[model.score(r[0])[0] for r in held]], pa.list_(pa.float64())),
            "labels": pa.array([[r[1] for r in held]], pa.list_(pa.float64())),
        }
    )


def fit_labelled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "abusive", max_labelled: int = MAX_LABELLED) -> Fitted | None:
    """A model from a bounded sample of distinct labelled texts, trained in FOLDS tasks; None without both kinds of label. The driver
    gets FOLDS models of 1 MB and at most ``max_labelled`` scores."""
    valid = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    votes = valid.groupBy(F.col(id_col).alias("doc")).agg(F.sum(F.col(label_col).cast("double")).alias("said"), F.count("*").alias("votes"))
    bodies = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("string").alias("body")).filter("body is not null").withColumns({"h1": F.xxhash64("body"), "h2": F.xxhash64(F.lit(1), "body")})
    # only ids and hashes of texts are shuffled
    voted = bodies.drop("body").join(votes, "doc").dropDuplicates(["doc", "h1", "h2"])
    chosen = voted.groupBy("h1", "h2").agg(F.min("doc").alias("doc"), (F.sum("said") / F.sum("votes")).alias("y")).filter("y <> 0.5").orderBy("h1", "h2").limit(max_labelled)
    # at most max_labelled rows, so the broadcast is bounded
    texts = bodies.join(F.broadcast(chosen), ["doc", "h1", "h2"]).dropDuplicates(["h1", "h2"])
    texts = materialize(texts.select("body", "y", F.pmod("h2", F.lit(FOLDS)).cast("int").alias("part")), "labelled")
    kinds = texts.agg(F.count_if(F.col("y") > 0.5).alias("bad"), F.count_if(F.col("y") < 0.5).alias("good")).first()
    if kinds["bad"] < 2 or kinds["good"] < 2:
        return None
    # so many partitions that no two folds share one
    marks = [r[0] for r in docs.sparkSession.range(FOLDS).select(F.hash(F.col("id").cast("int"))).collect()]
    parts = next(n for n in range(FOLDS, 1000) if len({m % n for m in marks}) == FOLDS)
    folds = texts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)))).repartition(parts, "fold")
    got = folds.groupBy("fold").applyInArrow(_fit_fold, "rows binary, bias double, scores array<double>, labels array<double>").toArrow()
    rows = np.mean([np.frombuffer(r.as_py(), np.float32) for r in got["rows"]], axis=0)
    flat = lambda c: np.array([x for r in got[c].to_pylist() for x in r])
    return Fitted(Model(rows.astype(np.float32), float(np.mean(got["bias"].to_numpy()))), flat("scores"), (flat("labels") > 0.5).astype(float))


def save_fitted(spark: SparkSession, fitted: Fitted, path: str) -> None:
    """One row: the model's numbers (1 MB) and the held-out scores, for later runs and other applications."""
    row = (bytearray(fitted.model.rows.astype("<f4").tobytes()), fitted.model.bias, fitted.scores.tolist(), fitted.labels.tolist())
    spark.createDataFrame([row], "rows binary, bias double, scores array<double>, labels array<double>").write.mode("overwrite").parquet(path)


def load_fitted(spark: SparkSession, path: str) -> Fitted:
    r = spark.read.parquet(path).first()
    return Fitted(Model(np.frombuffer(bytes(r["rows"]), "<f4").copy(), r["bias"]), np.array(r["scores"]), np.array(r["labels"]))


def choose_threshold(scores: np.ndarray, y: np.ndarray, counts: np.ndarray) -> float:
    """The threshold with the best F1 over all documents, of which ``counts`` says how many score in each of its equal steps.

    Held-out labelled documents are no random sample, so they only tell which share of the positives a threshold finds. How many
    positives that are among all documents follows from the score that half of the labelled positives reach: of all documents above
    it the part that its labelled ones confirm is positive."""
    bins = len(counts)
    above = counts[::-1].cumsum()[::-1].astype(float)  # documents in step k and higher
    step = np.minimum((scores * bins).astype(int), bins - 1)
    found = np.bincount(step[y > 0], minlength=bins)[::-1].cumsum()[::-1] / max(1.0, y.sum())
    half = int(np.flatnonzero(found >= 0.5)[-1])
    sure = y[step >= half].mean() * above[half] / found[half]
    f1 = 2 * sure * found / np.maximum(sure + np.maximum(above, sure * found), 1e-12)
    best = np.flatnonzero(f1 >= f1[1:].max() - 1e-12)
    return float(best[best > 0][-1]) / bins


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "abusive", keep: tuple[str, ...] = (), fitted: Fitted | None = None) -> DataFrame:
    """(id, *keep, score, is_abusive, passage) for every document: its worst passage's probability and whether it passes the threshold.
    ``fitted`` is what ``fit_labelled`` gave, if it ran before. Every text is read once; the threshold is set from the scores."""
    fitted = fitted or fit_labelled(docs, labels, id_col, text_col, label_col)
    types = dict(docs.dtypes)
    if fitted is None:
        none = F.lit(None).cast("string")
        return docs.select(id_col, *keep, F.lit(0.0).alias("score"), F.lit(False).alias("is_abusive"), none.alias("passage"))
    # one number for each of the 2^18 hash rows: 1 MB
    held = docs.sparkSession.sparkContext.broadcast(fitted.model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            found = [m.score(t.as_py()) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([s for s, _ in found], pa.float64()), pa.array([p for _, p in found], pa.string())], names=[id_col, *keep, "score", "passage"])

    schema = ", ".join([f"`{c}` {types[c]}" for c in (id_col, *keep)] + ["score double, passage string"])
    scored = materialize(docs.select(F.col(text_col).cast("string"), id_col, *keep).mapInArrow(run, schema), "scored")
    counts = np.zeros(BINS, np.int64)
    # at most BINS rows
    for r in scored.groupBy(F.least(F.floor(F.col("score") * BINS), F.lit(BINS - 1)).alias("step")).count().collect():
        counts[r["step"]] = r["count"]
    threshold = choose_threshold(fitted.scores, fitted.labels, counts)
    return scored.select(id_col, *keep, "score", (F.col("score") >= threshold).alias("is_abusive"), "passage")
