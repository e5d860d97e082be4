"""Problem 10: the subject areas that each document is about.

Complement naive Bayes learned from labelled documents, refined by expectation-maximisation over all documents, with calibrated
independent posteriors for the subjects.

A document is read as segments (sentences, lines). Naive Bayes scores every segment for each subject and for a background class,
which takes up the sentences that are about nothing in particular; a subject's weights are those of complement naive Bayes, the log
ratio of a feature's rate in the subject to its rate everywhere else, for and against. The first weights come from labelled documents; each round of EM
then assigns the segments of *all* documents softly (a labelled document's segments to its own subjects and the background) and counts features
anew. While training, a segment's prior follows the rest of its document: where other segments belong to a subject, an undecided one leans to it,
which is how words that no labelled document holds find their subject. A document's evidence for a subject is how many of its segments belong to it, absolutely
and as a share, so a passing mention stays one segment. A logistic calibration per evidence turns it into independent posteriors; it is
fitted on labelled documents in FOLDS folds, each scored by weights from which the features of its own fold were taken away.

Features are words, their first letters without diacritics (words of one origin meet across languages) and pairs of neighbouring words (of
Chinese and Japanese runs: character pairs), hashed into BUCKETS buckets, so the model has one size whatever the corpus: (subjects + 1) x BUCKETS
numbers, the only thing that goes to the tasks. Tasks send back sums per cell, of as few partitions as keep all cores busy.

Bounds: calibration uses at most CALIBRATION labelled documents (those with the lowest hash of the id), a model has at most MAX_SUBJECTS
subjects, and languages beyond the LANGUAGES most frequent share one row in the language shares (only there; no document is left out). Every
other count covers all documents. Defined results: null, empty and blank texts have no subject; a labelled document gets none from us (its
subjects are known); labels of unknown documents or subjects are ignored; without labels there is no model and the result is empty.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstack.runtime import table, written

BUCKETS = 1 << 16
ROUNDS = 3
#: Labelled documents used to fit the calibration, and its folds.
CALIBRATION, FOLDS = 20_000, 5
#: Subjects are a fixed list; the model's size depends on their number.
MAX_SUBJECTS = 256
SMOOTHING = 0.5
#: Leanings below MARGIN count as none; LEAST and MOST bound what one feature may say against and for a subject.
MARGIN, LEAST, MOST = 1.0, 2.0, 5.0
#: Log odds of a segment to be about a subject rather than background; weight of the rest of its document while training.
PRIOR, COHERENCE = -5.0, 1.0
THRESHOLD = 0.5
#: Quantile of the labelled documents that marks the least share of segments on subjects.
FLOOR = 0.001
#: Share of responsibility that a labelled document's segments may give to subjects that it does not have (passing mentions).
SLACK = 0.02
#: First letters of a word of more than PREFIX letters.
PREFIX = 5

#: An end of a segment (a line end, a stop before white space, a full-width stop) or a word.
TOKEN = re.compile(r"[\r\n]+|[.!?;](?=\s)|[。！？]|[A-ZÀ-ÖØ-Þ]?[a-zß-öø-ÿ]+|[A-ZÀ-ÖØ-Þ]+(?![a-zß-öø-ÿ])|[぀-ヿ㐀-鿿々ヶー]+|[^\W\d_A-Za-zÀ-ÿ぀-ヿ㐀-鿿]+")
_STOP = frozenset("\r\n.!?;。！？")


class Featurizer:
    """Hashed features of texts, in batches. A token is looked up once; the rest is arithmetic over the batch."""

    #: Tokens kept between batches.
    KEPT = 200_000

    def __init__(self) -> None:
        self._clear()

    def _clear(self) -> None:
        # Token 0 is the end of a segment. Per token: its place in ``flat``, number of features, and its hash for pairs (0: takes part in none).
        self.ids: dict[str, int] = {}
        self.flat: list[int] = []
        self.start, self.size, self.hash = [0], [0], [0]

    def _new(self, token: str) -> int:
        if token[0] in _STOP:
            self.ids[token] = 0
            return 0
        if token[0] >= "぀":
            feats, h = [zlib.crc32(token[i:i + 2].encode()) for i in range(len(token) - 1)], 0
        else:
            w = token.lower()
            h = zlib.crc32(w.encode()) | 1 << 32
            feats = [h] if len(w) > 1 else []
            if len(w) > PREFIX:
                plain = unicodedata.normalize("NFD", w[:PREFIX + 2]).encode("ascii", "ignore")[:PREFIX]
                feats += [zlib.crc32(b"~" + plain)] if len(plain) == PREFIX else []
        k = self.ids[token] = len(self.start)
        self.start.append(len(self.flat))
        self.size.append(len(feats))
        self.hash.append(h)
        self.flat += [f & (BUCKETS - 1) for f in feats]
        return k

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(features, features of each segment, segments of each document); the features of a segment are distinct, and segments without any are left out."""
        if len(self.ids) > self.KEPT:
            self._clear()
        known, new, toks, ends = self.ids, self._new, [], []
        for t in texts:
            if t:
                toks += [known[w] if w in known else new(w) for w in TOKEN.findall(t)]
            toks.append(0)
            ends.append(len(toks))
        tok = np.array(toks, np.int64)
        start, size, pair, flat = (np.array(a, np.int64) for a in (self.start, self.size, self.hash, self.flat))
        seg = np.cumsum(tok == 0) - (tok == 0)
        n = size[tok]
        one = flat[np.repeat(start[tok] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        h = pair[tok]
        both = (h[:-1] > 0) & (h[1:] > 0)
        with np.errstate(over="ignore"):
            mixed = (h[:-1][both] * np.int64(0x9E3779B1) + h[1:][both]) * np.int64(0x2545F4914F6CDD1D)
        two = (mixed >> 40) & (BUCKETS - 1)
        cells = np.sort(np.concatenate([np.repeat(seg, n), seg[:-1][both]]) * BUCKETS + np.concatenate([one, two]))
        cells = cells[np.diff(cells, prepend=-1) > 0]
        of = cells // BUCKETS
        first = np.flatnonzero(np.diff(of, prepend=-1))
        of, lens = of[first], np.diff(first, append=len(cells))
        last = np.searchsorted(of, seg[np.array(ends, np.int64) - 1], side="right")
        return (cells % BUCKETS).astype(np.int32), lens, np.diff(last, prepend=0)


def segments(text: str | None) -> list[list[int]]:
    """Hashed features of each segment of a text."""
    feats, lens, _ = Featurizer()([text])
    return [x.tolist() for x in np.split(feats, np.cumsum(lens)[:-1])] if len(lens) else []


def weights(counts: np.ndarray, mass: np.ndarray, by_lang: np.ndarray) -> np.ndarray:
    """Complement weights (BUCKETS, classes); the last class is the background, weight 0.

    ``counts`` (BUCKETS, classes) are the feature counts by class, ``mass`` (languages, classes) how the classes share each language and
    ``by_lang`` (BUCKETS, languages) the features of each language. A weight is the log odds ratio of the observed count of a feature in a
    subject to the count expected from the languages that it occurs in, against the same for all other classes. Without the
    languages' shares, the common words of a language would lean to the subjects that its labelled documents happen to have.
    """
    share = mass / np.maximum(mass.sum(axis=1, keepdims=True), 1e-9)
    expected = by_lang @ share
    scale = counts.sum(axis=1, keepdims=True) / np.maximum(by_lang.sum(axis=1, keepdims=True), 1e-9)
    expected = expected * scale
    n, e = counts.sum(axis=1, keepdims=True), expected.sum(axis=1, keepdims=True)
    w = np.log((counts + SMOOTHING) / (expected + SMOOTHING)) - np.log((np.maximum(n - counts, 0) + SMOOTHING) / (np.maximum(e - expected, 0) + SMOOTHING))
    w = np.clip(np.where(w > 0, np.maximum(w - MARGIN, 0), np.minimum(w + MARGIN, 0)), -LEAST, MOST)
    w[:, -1] = 0
    return w.astype(np.float32)


def per_document(shares: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """Sums of segment rows by document."""
    ends = np.concatenate([np.zeros((1, shares.shape[1])), np.cumsum(shares, axis=0, dtype=np.float64)])
    at = np.cumsum(per_doc)
    return ends[at] - ends[at - per_doc]


def responsibilities(feats: np.ndarray, starts: np.ndarray, per_doc: np.ndarray, w: np.ndarray, bound: tuple[np.ndarray, np.ndarray] | None = None, coherence: float = 0.0) -> np.ndarray:
    """Class shares of each segment; ``bound`` = (segments, factors) multiplies those of some segments before they are normed, ``coherence`` makes the prior follow the rest of the document."""
    classes = w.shape[1]
    if not len(starts):
        return np.zeros((0, classes), np.float32)
    score = np.add.reduceat(w[feats], starts, axis=0)

    def normed(prior: np.ndarray) -> np.ndarray:
        p = score + prior
        p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        if bound is not None:
            p[bound[0]] *= bound[1]
        p /= p.sum(axis=1, keepdims=True)
        return p

    prior = np.full(classes, PRIOR, np.float32)
    prior[-1] = 0
    r = normed(prior)
    if not coherence:
        return r
    doc = np.repeat(np.arange(len(per_doc)), per_doc)
    sure = np.where(r > 0.5, r, 0)
    rest = np.maximum(per_document(sure, per_doc).astype(np.float32)[doc] - sure, 0) / np.maximum(per_doc[doc] - 1, 1).astype(np.float32)[:, None]
    leaning = np.log(np.float32(np.exp(PRIOR)) + np.float32(coherence) * rest)
    leaning[:, -1] = 0
    return normed(leaning)


def evidence(resp: np.ndarray, per_doc: np.ndarray) -> np.ndarray:
    """(documents, classes): summed segment shares; a share below one half is no assignment and counts for nothing."""
    return per_document(np.where(resp > 0.5, resp, 0), per_doc)


def indicators(ev: np.ndarray) -> np.ndarray:
    """Per document and subject, the inputs of the calibration: count, share of all subjects' segments, share of all segments."""
    s = np.maximum(ev[:, :-1], 0)
    total = s.sum(axis=1, keepdims=True)
    best = s.max(axis=1, keepdims=True) if s.size else s
    return np.stack([
        np.log(s + 0.05), s / (total + 0.2), s / (ev.sum(axis=1, keepdims=True) + 0.2), s / (best + 0.05), np.minimum(s, 1.0), np.ones_like(s)], axis=-1)


def fit_logistic(x: np.ndarray, y: np.ndarray, rounds: int = 30, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def posteriors(ev: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(indicators(ev) @ b, -30, 30)))


# ---- the distributed part ---------------------------------------------------------------------------------------------------
LANGUAGES = 15
#: ``feats`` holds the features of all segments as 16 bit numbers, ``lens`` the features of each segment as 32 bit numbers.
FEATURES = "doc_id long, lang int, fold int, subjects array<int>, feats binary, lens binary"
CELLS = "cell long, value double"


def _blobs(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive runs of a numeric array as binary values."""
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values, length of each row) of a column written by ``_blobs``."""
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]] if len(column) else np.zeros(0, np.uint8)
    return data.view(kind), np.diff(ends) // np.dtype(kind).itemsize


def featured(documents: DataFrame, labels: DataFrame, subjects: list[str], langs: list[str]) -> DataFrame:
    """Hashed segments of every document with its language and known subjects, as indexes, and the fold of a labelled one."""
    index = {s: k for k, s in enumerate(subjects)}
    place = {s: k for k, s in enumerate(langs)}
    known = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("names"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer()
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                feats, lens, per_doc = features(batch.column("text").to_pylist())
                per = per_document(lens[:, None], per_doc)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array([place.get(x, len(langs)) for x in batch.column("lang").to_pylist()], pa.int32()), batch.column("fold"),
                    pa.array([None if n is None else [index[x] for x in n] for n in batch.column("names").to_pylist()], pa.list_(pa.int32())),
                    _blobs(feats.astype(np.uint16), per), _blobs(lens.astype(np.int32), per_doc)], ["doc_id", "lang", "fold", "subjects", "feats", "lens"])

    d = documents.select("doc_id", "text", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int").alias("fold"))
    return d.join(known, "doc_id", "left").mapInArrow(scan, FEATURES)


class _Docs:
    """A slice of a batch of FEATURES rows, flat."""

    def __init__(self, batch: pa.RecordBatch, classes: int):
        known = batch.column("subjects")
        seg, per_doc = _numbers(batch.column("lens"), np.int32)
        seg = seg.astype(np.int64)
        self.ids, self.lang, self.fold, self.subjects = batch.column("doc_id"), batch.column("lang").to_numpy(), batch.column("fold").to_numpy(), known
        self.feats, _ = _numbers(batch.column("feats"), np.uint16)
        self.starts = np.concatenate([[0], np.cumsum(seg)[:-1]]).astype(np.int64) if len(seg) else np.zeros(0, np.int64)
        self.per_doc = per_doc.astype(np.int64)
        self.seg_len = seg
        self.doc_of_seg = np.repeat(np.arange(batch.num_rows), self.per_doc)
        self.seg_of_feat = np.repeat(np.arange(len(seg)), seg)
        self.labelled = np.flatnonzero(known.is_valid().to_numpy(zero_copy_only=False))
        self.allowed = np.full((len(self.labelled), classes), SLACK, np.float32)
        self.own = np.zeros((len(self.labelled), classes), np.float32)
        self.allowed[:, -1] = 1
        for k, i in enumerate(self.labelled):
            mine = known[int(i)].as_py()
            self.allowed[k, mine] = 1
            self.own[k, mine] = 1 / len(mine)

    def shares(self, w: np.ndarray | None) -> np.ndarray:
        """Class shares of the segments as training has them: those of the labels, or of the weights within the labels."""
        at = np.full(len(self.per_doc), -1)
        at[self.labelled] = np.arange(len(self.labelled))
        at = at[self.doc_of_seg]
        segs = np.flatnonzero(at >= 0)
        if w is None:
            r = np.zeros((len(at), self.own.shape[1]), np.float32)
            r[segs] = self.own[at[segs]]
            return r
        return responsibilities(self.feats, self.starts, self.per_doc, w, (segs, self.allowed[at[segs]]), COHERENCE)


def _slices(batches: Iterator[pa.RecordBatch], classes: int, rows: int = 1000) -> Iterator[_Docs]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield _Docs(batch.slice(at, rows), classes)


def _few(features: DataFrame) -> DataFrame:
    """As few partitions as keep the cores busy: every one of them sends a model's worth of sums, whatever it has read."""
    most = 2 * features.sparkSession.sparkContext.defaultParallelism
    return features.coalesce(most) if features.rdd.getNumPartitions() > most else features


class Sums:
    """Counts of features by class, mass of classes by language, features by language."""

    def __init__(self, counts: np.ndarray, mass: np.ndarray, by_lang: np.ndarray):
        self.counts, self.mass, self.by_lang = counts, mass, by_lang

    def __sub__(self, other: "Sums") -> "Sums":
        return Sums(self.counts - other.counts, self.mass - other.mass, self.by_lang - other.by_lang)

    def completed(self) -> "Sums":
        """With the background's counts: what the subjects leave of the features."""
        self.counts[:, -1] = np.maximum(self.by_lang.sum(axis=1) - self.counts[:, :-1].sum(axis=1), 0)
        return self

    def weights(self) -> np.ndarray:
        return weights(self.counts, self.mass, self.by_lang)


#: A share of a segment below this counts for nothing.
LEAST_SHARE = 1e-3


def _sums(features: DataFrame, classes: int, langs: int, w: np.ndarray | None, with_langs: bool = True, folds: int = 1) -> list[Sums]:
    """Sums over all documents of ``features``, by fold if there are several; the background's counts are left out.

    Every task adds up dense arrays of the model's fixed size and sends their cells that are not zero.
    """
    width = classes + (langs if with_langs else 0)
    block = (BUCKETS + langs) * width

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((folds, width, BUCKETS + langs))
        for d in _slices(batches, classes):
            r, lang = d.shares(w), d.lang[d.doc_of_seg]
            fold = d.fold[d.doc_of_seg] if folds > 1 else np.zeros(len(d.starts), np.int64)
            r[r < LEAST_SHARE] = 0
            for f in np.unique(fold):
                mine = fold == f
                for c in range(classes - 1):
                    seg = np.flatnonzero(mine & (r[:, c] > 0))
                    if len(seg):
                        n = d.seg_len[seg]
                        at = np.repeat(d.starts[seg] - np.cumsum(n) + n, n) + np.arange(n.sum())
                        cells[f, c, :BUCKETS] += np.bincount(d.feats[at], weights=np.repeat(r[seg, c], n), minlength=BUCKETS)
                for k in np.unique(lang[mine]):
                    pick = (lang == k) & mine
                    cells[f, :classes, BUCKETS + k] += (r[pick] * d.seg_len[pick, None]).sum(axis=0)
                    if with_langs:
                        cells[f, classes + k, :BUCKETS] += np.bincount(d.feats[pick[d.seg_of_feat]], minlength=BUCKETS)
        cells = cells.ravel()
        at = np.flatnonzero(cells)
        for a in range(0, len(at), 50_000):
            part = at[a:a + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), pa.array(cells[part])], ["cell", "value"])

    got = _few(features).mapInArrow(scan, CELLS).groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    cells = np.zeros(folds * block)
    cells[got["cell"].to_numpy()] = got["value"].to_numpy()
    cells = cells.reshape(folds, width, BUCKETS + langs).swapaxes(1, 2)
    return [Sums(x[:BUCKETS, :classes], x[BUCKETS:, :classes], x[:BUCKETS, classes:]) for x in cells]


def train(features: DataFrame, classes: int, langs: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Weights after naive Bayes on the labelled documents and ROUNDS of EM over all, and for each fold the weights without its documents."""
    labelled = features.where("subjects is not null")
    w, by_lang = _sums(labelled, classes, langs, None)[0].weights(), None
    for _ in range(ROUNDS):
        before, total = w, _sums(features, classes, langs, w, with_langs=by_lang is None)[0]
        by_lang = total.by_lang if by_lang is None else by_lang  # the same in every round
        total.by_lang = by_lang
        w = total.completed().weights()
    own = _sums(labelled, classes, langs, before, folds=FOLDS)
    return w, [(total - s.completed()).weights() for s in own]


def calibrate(features: DataFrame, classes: int, held_out: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """Coefficients of the posteriors, and the least share of a document's segments that labelled documents give to subjects.

    No document is labelled as being about nothing, so that side is set by range: a document with a smaller part of its segments on
    any subject than labelled documents ever have only mentions it.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _slices(batches, classes):
            ev = np.zeros((len(d.per_doc), classes))
            for f in np.unique(d.fold):
                ev[d.fold == f] = evidence(responsibilities(d.feats, d.starts, d.per_doc, held_out[f]), d.per_doc)[d.fold == f]
            yield pa.RecordBatch.from_arrays([d.subjects, pa.array(list(ev), pa.list_(pa.float64()))], ["subjects", "ev"])

    sample = features.where("subjects is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(CALIBRATION)
    rows = sample.mapInArrow(scan, "subjects array<int>, ev array<double>").collect()
    e = np.array([r["ev"] for r in rows]).reshape(len(rows), classes)
    y = np.zeros((len(rows), classes - 1))
    for i, r in enumerate(rows):
        y[i, r["subjects"]] = 1
    x = indicators(e)
    shares = e[:, :-1].sum(axis=1) / np.maximum(e.sum(axis=1), 1e-9)
    seen = shares[shares > 0]
    return fit_logistic(x.reshape(-1, x.shape[-1]), y.ravel()), 0.9 * float(np.quantile(seen, FLOOR)) if len(seen) else 0.0


def classify(documents: DataFrame, labels: DataFrame, subjects: list[str]) -> DataFrame:
    """(doc_id, subject, posterior) of every document without labels, posteriors from THRESHOLD on."""
    spark = documents.sparkSession
    schema = "doc_id long, subject string, posterior double"
    if not subjects or labels.isEmpty():
        return spark.createDataFrame([], schema)
    if len(subjects) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    common = documents.where("lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect()
    langs = [r["lang"] for r in common]
    features = written(featured(documents, labels, subjects, langs), "features")
    classes = len(subjects) + 1
    if features.where("subjects is not null").isEmpty():
        return spark.createDataFrame([], schema)
    w, held_out = train(features, classes, len(langs) + 1)
    b, floor = calibrate(features, classes, held_out)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for d in _slices(batches, classes):
            e = evidence(responsibilities(d.feats, d.starts, d.per_doc, w), d.per_doc)
            p = posteriors(e, b)
            enough = (e[:, :-1].sum(axis=1) > 0) & (e[:, :-1].sum(axis=1) >= floor * e.sum(axis=1))
            i, k = np.nonzero((p >= THRESHOLD) & enough[:, None] & (e[:, :-1] > 1e-6))
            yield pa.RecordBatch.from_arrays([d.ids.take(pa.array(i)), pa.array([subjects[x] for x in k], pa.string()), pa.array(p[i, k])], ["doc_id", "subject", "posterior"])

    return features.where("subjects is null").mapInArrow(scan, schema)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    subjects = [r[0] for r in table(spark, sf_dir, "subjects", "subject").where("subject is not null").distinct().orderBy("subject").limit(MAX_SUBJECTS + 1).collect()]
    return classify(table(spark, sf_dir, "documents", "doc_id", "text", "lang"), table(spark, sf_dir, "subject_labels"), subjects).select("doc_id", "subject")
