"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine over labelled sentences.

Kernel of two words: the inner product of their gapped letter triples, to the power of three. A triple of letters (or a word's
beginning and two letters) spanning s places counts DECAY ** (s - 3), spans over SPAN count nothing, and a word is scaled by the root of its
squared weights, so an insult keeps most of its triples when characters are inserted or its ending changes. Kernel of two
sentences: the sum of the kernels of their distinct words, over the root of both sentences' numbers of words.

Training: a sentence has its document's label, and in a toxic document at least one sentence is to blame (multiple instances). The first round
takes random sentences of both labels; then each toxic document's best sentence stands for it, and clean documents' best
sentences are hard cases. The support vector machine learns in the Nystroem space of landmark words. A logistic curve over a document's best sentence
and its number of sentences over the margin gives the score; it is fitted on a validation fold of documents that the machine hasn't seen.

By linearity over words a trained machine gives each word a number, which a worker computes once for each word it meets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrykit.llm.encoding import spans

DECAY, SPAN, POWER, ROUNDS = 0.6, 6, 3, 4
#: Classes of letters: digits 0, a to z 1 to 26, others 27 to 39 by their code, and a word's beginning.
START, CLASSES = 40, 41
#: Offsets of the second and third letter of a triple, and the triple's weight.
TRIPLES = [(j, k, DECAY ** (k - 2)) for k in range(2, SPAN) for j in range(1, k)]
#: In the string of a text's classes letters are bytes from FIRST on.
SKIP, STOP, BLANK, FIRST = 0, 10, 32, 64
#: Words of more letters are taken one by one, all of one length together otherwise.
LONG = 24
WIDE = 0x3000


def _letter_table() -> np.ndarray:
    """The byte of every code point under WIDE."""
    out = np.full(WIDE, SKIP, np.uint8)
    for c in range(WIDE):
        x = chr(c)
        if x.isspace():
            out[c] = BLANK
        elif x.isdigit():
            out[c] = FIRST
        elif x.isalpha():
            low = x.lower()[0]
            out[c] = FIRST + (ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % (START - 27))
    return out


LETTER = _letter_table()
#: A sentence ends at one of these before white space or the text's end, at a line's end, and at a wide full stop.
ENDS = np.zeros(WIDE, bool)
ENDS[[ord(c) for c in ".!?\u2026"]] = True
WIDE_ENDS = (0x3002, 0xFF01, 0xFF1F)


def letters(text: str | None) -> bytes:
    """The text's letters by class, words apart by blanks and sentences by line ends. Punctuation is passed over; single letters apart by blanks are one word."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    if not len(codes):
        return b""
    wide = codes >= WIDE
    narrow = np.where(wide, 0, codes)
    cls = LETTER[narrow]
    stop = ENDS[narrow]
    stop[:-1] &= cls[1:] == BLANK
    stop |= codes == 10
    if wide.any():
        cls[wide] = FIRST + 27 + codes[wide] % (START - 27)
        stop |= np.isin(codes, WIDE_ENDS)
    cls[stop] = STOP
    cls = cls[cls != SKIP]
    apart = np.concatenate([[True], cls < FIRST, [True]])
    single = ~apart[1:-1] & apart[:-2] & apart[2:]
    between = np.zeros(len(cls), bool)
    between[1:-1] = (cls[1:-1] == BLANK) & single[:-2] & single[2:]
    return (cls[~between] if between.any() else cls).tobytes()


def sentences(raw: bytes) -> list[set[bytes]]:
    """The distinct words of every sentence that has any, from what ``letters`` gives."""
    return [w for w in (set(s.split()) for s in raw.split(b"\n")) if w]


def _norm(length: int) -> float:
    return max(1.0, sum(max(0, length + 1 - k) * w * w for _, k, w in TRIPLES)) ** 0.5  # of the squared weights, as if no triple came twice


def _numbers(words: list[bytes], length: int) -> Iterator[tuple[np.ndarray, float]]:
    """(number of the triple of each word, weight) for every place and gap; all words have the same length."""
    c = np.full((len(words), length + 1), START, np.int32)
    c[:, 1:] = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), length) - FIRST
    for j, k, w in TRIPLES:
        for p in range(length + 1 - k):
            yield (c[:, p] * CLASSES + c[:, p + j]) * CLASSES + c[:, p + k], w


def _long_numbers(word: bytes) -> Iterator[tuple[np.ndarray, float]]:
    """(numbers of all triples of one gap, weight) for every gap."""
    c = np.full(len(word) + 1, START, np.int32)
    c[1:] = np.frombuffer(word, np.uint8)
    c[1:] -= FIRST
    for j, k, w in TRIPLES:
        n = max(0, len(c) - k)
        yield (c[:n] * CLASSES + c[j : n + j]) * CLASSES + c[k : n + k], w


class Landmarks:
    """The kernel of any words with the landmark words."""

    def __init__(self, words: list[bytes]) -> None:
        self.words = words
        cells: dict[tuple[int, int], float] = {}
        for m, word in enumerate(words):
            for numbers, w in _long_numbers(word):
                for number in numbers.tolist():
                    cells[number, m] = cells.get((number, m), 0.0) + w / _norm(len(word))
        rows = sorted({n for n, _ in cells})
        self.row = np.zeros(CLASSES**3, np.int32)  #: row of the table for each triple; 0 where no landmark has it
        self.row[rows] = np.arange(1, len(rows) + 1)
        self.table = np.zeros((len(rows) + 1, len(words)), np.float32)
        for (n, m), w in cells.items():
            self.table[self.row[n], m] = w

    def kernel(self, words: list[bytes], most: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of some of the words, their kernel with each landmark)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        cut = np.flatnonzero(np.diff(lengths[order])) + 1
        for same in np.split(order, cut) if len(order) else []:
            length = int(lengths[same[0]])
            if length > LONG:
                for i in same.tolist():
                    k = np.zeros(len(self.words))
                    for number, w in _long_numbers(words[i]):
                        row = self.row[number]
                        k += w * (np.bincount(row, minlength=len(self.table)) @ self.table if len(row) > len(self.table) else self.table[row].sum(0))
                    yield np.array([i]), np.minimum(k[None] / _norm(length), 1).astype(np.float32) ** POWER
                continue
            for a in range(0, len(same), most):
                some = same[a : a + most]
                k = np.zeros((len(some), len(self.words)), np.float32)
                for number, w in _numbers([words[i] for i in some.tolist()], length):
                    row = self.row[number]
                    hit = np.flatnonzero(row)
                    k[hit] += self.table[row[hit]] * np.float32(w)
                yield some, np.minimum(k / np.float32(_norm(length)), 1) ** POWER


def kernel(a: str, b: str) -> float:
    """Of two words, as they are written."""
    ((_, k),) = Landmarks([letters(b)]).kernel([letters(a)])
    return float(k[0, 0])


def _svm(z: np.ndarray, y: np.ndarray, weight: np.ndarray, reg: float = 1e-4, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge linear support vector machine by Newton steps over the rows inside the margin."""
    x = np.hstack([z, np.ones((len(z), 1))])
    penalty = np.eye(x.shape[1]) * reg
    penalty[-1, -1] = 1e-8
    v = np.zeros(x.shape[1])
    for _ in range(steps):
        inside = y * (x @ v) < 1
        a, b, w = x[inside], y[inside], weight[inside]
        new = np.linalg.solve(penalty + (a * w[:, None]).T @ a, (a * w[:, None]).T @ b)
        if np.allclose(new, v, atol=1e-9):
            break
        v = new
    return v[:-1], float(v[-1])


@dataclass
class Model:
    words: list[bytes]  #: landmark words
    weight: np.ndarray  #: of each landmark's kernel
    bias: float
    curve: np.ndarray  #: logistic weights of the document's features
    most_words: int = 120_000  #: words whose numbers a worker keeps at a time
    known: dict[bytes, float] = field(default_factory=dict, repr=False)
    marks: Landmarks | None = field(default=None, repr=False)

    def learn(self, words: list[bytes]) -> None:
        """Compute the words' numbers."""
        self.marks = self.marks or Landmarks(self.words)
        for at, k in self.marks.kernel(words):
            self.known.update(zip([words[i] for i in at.tolist()], (k @ self.weight).tolist(), strict=True))

    def features(self, texts: list[str | None]) -> np.ndarray:
        """The best sentence, the sentences over the margin, and a constant, of each text."""
        if len(self.known) > self.most_words:
            self.known.clear()
        raws = [letters(t) for t in texts]
        fresh: set[bytes] = set()
        for raw in raws:
            fresh |= set(raw.split()).difference(self.known)
        self.learn(sorted(fresh))
        number, out = self.known.__getitem__, np.empty((len(texts), 3))
        for i, raw in enumerate(raws):
            s = [sum(map(number, w)) / len(w) ** 0.5 + self.bias for w in sentences(raw)]
            out[i] = max(-3.0, min(3.0, max(s, default=-3.0))), np.log1p(sum(x > 0 for x in s)), 1.0
        return out

    def scores(self, texts: list[str | None]) -> list[float]:
        """Between 0 and 1; a text without words has a score like others, that of no evidence."""
        out: list[float] = []
        for a, b in spans(texts):
            out += (1 / (1 + np.exp(-np.clip(self.features(texts[a:b]) @ self.curve, -30, 30)))).tolist()
        return out

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]


class _Sample:
    """Sentences of the training documents, as numbers of words."""

    def __init__(self, texts: list[str | None]) -> None:
        index: dict[bytes, int] = {}
        ids, sizes, doc = [], [], []
        for i, t in enumerate(texts):
            for words in sentences(letters(t)):
                ids += [index.setdefault(w, len(index)) for w in sorted(words)]
                sizes.append(len(words))
                doc.append(i)
        self.words, self.ids, self.size, self.doc = list(index), np.array(ids, np.int64), np.array(sizes, np.int64), np.array(doc, np.int64)
        self.end = np.cumsum(self.size)
        self.sentence = np.repeat(np.arange(len(sizes)), self.size)

    def of(self, sentence: int) -> np.ndarray:
        return self.ids[self.end[sentence] - self.size[sentence] : self.end[sentence]]

    def projected(self, some: np.ndarray, marks: Landmarks) -> np.ndarray:
        """The kernel of some sentences with each landmark (as a sentence of one word)."""
        distinct, inverse = np.unique(np.concatenate([self.of(x) for x in some]), return_inverse=True)
        k = np.empty((len(distinct), len(marks.words)), np.float32)
        for at, part in marks.kernel([self.words[i] for i in distinct.tolist()]):
            k[at] = part
        size = self.size[some]
        end = np.cumsum(size)
        out = np.empty((len(some), len(marks.words)), np.float32)
        for a in range(0, len(some), 1000):
            first, upto = end[a] - size[a], end[min(a + 1000, len(some)) - 1]
            out[a : a + 1000] = np.add.reduceat(k[inverse[first:upto]], end[a : a + 1000] - size[a : a + 1000] - first, 0)
        return out / np.sqrt(size, dtype=np.float32)[:, None]


def _fit(c: _Sample, toxic: np.ndarray, landmarks: int, each: int, seed: int = 5) -> tuple[list[bytes], np.ndarray, float]:
    """(landmark words, their weights, bias)."""
    rng = np.random.default_rng(seed)
    some = lambda x, n: rng.choice(x, min(n, len(x)), False)
    label = toxic[c.doc]
    bad, clean = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    # first landmarks: words more often in toxic documents than in clean ones, frequent words of clean ones, and others of theirs
    pairs = np.unique(c.doc[c.sentence] * len(c.words) + c.ids)
    doc, word = np.divmod(pairs, len(c.words))
    in_bad, in_clean = (np.bincount(word[toxic[doc] == x], minlength=len(c.words)) for x in (1, 0))
    lean = (in_bad + 0.1) / ((in_clean + 0.5) * max(1, len(toxic) - toxic.sum())) * np.minimum(1, in_bad / 8) * (np.fromiter(map(len, c.words), int, len(c.words)) > 2)
    accused, common = np.argsort(-lean, kind="stable")[: landmarks // 2], np.argsort(-in_clean, kind="stable")[: landmarks // 4]
    marks = np.unique(np.concatenate([accused, common, some(np.flatnonzero(in_clean), landmarks // 4)]))
    blamed, hard = some(bad, each), clean[:0]
    for turn in range(ROUNDS):
        table = Landmarks([c.words[i] for i in marks.tolist()])
        own = np.zeros((len(marks), len(marks)))
        for at, k in table.kernel(table.words):
            own[at] = k
        values, vectors = np.linalg.eigh((own + own.T) / 2)
        good = values > 1e-3
        whiten = vectors[:, good] / np.sqrt(values[good])  # Nystroem: z(s) = K_mm^(-1/2) k_m(s)
        free = np.unique(np.concatenate([hard, some(clean, each // (1 if turn == 0 else 2))]))
        y = np.repeat([1.0, -1.0], [len(blamed), len(free)])
        v, bias = _svm(c.projected(np.concatenate([blamed, free]), table) @ whiten, y, np.where(y > 0, 50 / len(blamed), 50 / len(free)))
        weight = (whiten @ v).astype(np.float32)
        if turn == ROUNDS - 1:
            break
        number = np.empty(len(c.words))
        for at, k in table.kernel(c.words):
            number[at] = k @ weight
        s = np.bincount(c.sentence, number[c.ids], minlength=len(c.size)) / np.sqrt(c.size)
        order = np.lexsort((-s, c.doc))
        best = order[np.concatenate([[True], np.diff(c.doc[order]) > 0])]
        mine, theirs = best[label[best] == 1], best[label[best] == 0]
        blamed = mine[s[mine] > np.quantile(s[theirs], 0.9)]
        blamed = blamed if len(blamed) >= 20 else mine
        hard = np.unique(np.concatenate([hard, theirs]))
        worst = lambda x: np.unique([w[number[w].argmax()] for w in map(c.of, x)])
        marks = np.unique(np.concatenate([accused[: landmarks // 4], some(worst(blamed), landmarks // 2), worst(theirs[np.argsort(-s[theirs])][: landmarks // 4]), common]))
    return table.words, weight, bias


def train(texts: list[str | None], toxic: list[int], landmarks: int = 192, sentences_each: int = 12_000) -> Model:
    """Fit on labelled documents; a round takes at most ``sentences_each`` random sentences of each label, and one of each document.

    Every fifth document of each label is the validation fold. Without both labels, or without a word in either, the model gives every text the same score: 1 if
    all are toxic, else 0.
    """
    y = np.array(toxic, np.int64)
    flat = Model([], np.zeros(0, np.float32), -1.0, np.array([0, 0, 30.0 if len(y) and y.all() else -30.0]))
    nth = np.zeros(len(y), np.int64)
    for x in (0, 1):
        nth[y == x] = np.arange((y == x).sum())
    held = nth % 5 == 4
    if not held[y == 1].any() or not held[y == 0].any():
        held[:] = False  # too few for a fold of their own
    c = _Sample([t for t, h in zip(texts, held, strict=True) if not h])
    if len(set(y[~held][c.doc].tolist())) < 2:
        return flat
    model = Model(*_fit(c, y[~held], landmarks, sentences_each), np.zeros(3))
    del c
    seen = held if held.any() else ~held
    x, y = np.concatenate([model.features([t]) for t, h in zip(texts, seen, strict=True) if h]), y[seen]
    cost = np.where(y == 1, 1.0, CLEAN_COST)
    curve = np.zeros(3)
    for _ in range(200):  # logistic regression by short Newton steps, lightly held back
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        w = cost * p * (1 - p) + 1e-6
        step = np.linalg.solve((x * w[:, None]).T @ x + 0.3 * np.eye(3), x.T @ (cost * (y - p)) - 0.3 * curve)
        curve = curve + step * min(1.0, 0.5 / np.abs(step).max())
        if np.abs(step).max() < 1e-8:
            break
    model.known.clear()
    model.marks, model.curve = None, curve
    return model


#: What a clean document counts on the curve's fold against a toxic one: the sample is balanced, the corpus is mostly clean.
CLEAN_COST = 5.0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = 1500, id_col: str = "doc_id", text_col: str = "text") -> tuple[list[str], list[int]]:
    """The labelled sample, whole texts: rows whose crc32(id as text) mod 5 isn't 0, at most ``most`` of each label, smallest hashes of the id first.

    Rows without an id, a text or a 0/1 label aren't trained on; empty texts are. A repeated id is drawn once, with all its rows. Empty tables give an empty sample.
    """
    learn = F.crc32(F.encode(F.col("_id").cast("string"), "UTF-8")) % 5 != 0
    lab = labels.select(F.col(id_col).alias("_id"), F.col("toxic").cast("int").alias("toxic")).where(learn & F.col("toxic").isin(0, 1))
    drawn = lab.distinct().withColumn("_o", F.xxhash64("_id"))
    drawn = drawn.where("toxic = 1").orderBy("_o", "_id").limit(most).unionByName(drawn.where("toxic = 0").orderBy("_o", "_id").limit(most)).select("_id", "toxic")
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    rows = texts.join(F.broadcast(drawn), "_id").select("_id", "text", "toxic").orderBy("_id", "text", "toxic").collect()  # 2 * most ids
    return [r["text"] for r in rows], [r["toxic"] for r in rows]


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row.

    Null, empty and wordless texts score as a text without words. Repeated ids give repeated rows; a null id is not held out. An empty table gives no rows.
    Columns other than id and text are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            held = [zlib.crc32(str(i).encode()) % 5 == 0 if i is not None else False for i in ids.to_pylist()]
            score = shared.value.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([ids, pa.array(held, pa.bool_()), pa.array(score, pa.float64()), pa.array([int(s >= 0.5) for s in score], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows whose score is under 0.5, with all their columns and no other; null and empty texts are judged as texts without words, repeated rows alike."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def toxic(texts):
        import pandas as pd

        return pd.Series([s >= 0.5 for s in shared.value.scores(list(texts))], dtype=bool)

    return docs.where(~toxic(F.col(text_col)))
