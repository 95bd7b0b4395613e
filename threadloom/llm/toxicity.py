"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs and digit substitutions to the letters they stand for, and turns all
that is no letter into single spaces. The lexicon is learned from labelled rows: beginnings of words whose
share of toxic rows is far above their share of the others. Words that begin alike but that clean rows use
as well become exceptions, beside any phrases that the caller gives; a match within an exception does not count.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Labelled rows that the model is fitted on, per label, taken in the order of a hash of doc_id.
SAMPLE = 6000
#: Entries of the lexicon at most, and of learned exceptions.
ENTRIES = 500
STEM = (4, 10)
#: A stem is taken if it is in this share of the toxic sample, and so much (log-odds) rarer in the rest.
SHARE, LOG_ODDS = 0.01, 3.5
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = dict(zip("авеёзіїјкмнорсстухѕԁһӏԛԝαβεικνορτυχ", "abeesiijkmhopccтyxsdhlqwabeikvoptux".replace("т", "t"), strict=True))
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l"}


#: Taken off the ends of words before signs are read as letters.
SIGNS = "!|@$.,;:?\"')]}"


def _table() -> dict[int, str]:
    table = {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
    table |= {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF10 + i: SUBSTITUTES.get(str(i), str(i)) for i in range(10)}
    table |= dict.fromkeys((0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0x00AD), "")
    table |= {c: " " for c in range(128) if not chr(c).isalpha() and c not in table}
    return table


TABLE = _table()


def fold(text: str) -> str:
    """Words of the folded text, each between single spaces. A sign at the end of a word is punctuation, not a letter."""
    words = text.lower().split()
    return f" {' '.join(' '.join(w.rstrip(SIGNS) for w in words).translate(TABLE).split())} "


@dataclass
class Model:
    stems: dict[str, float]
    exceptions: list[str]
    coefficients: tuple[float, float, float]
    _automaton: object = field(default=None, repr=False)

    def __getstate__(self):
        return {"stems": self.stems, "exceptions": self.exceptions, "coefficients": self.coefficients, "_automaton": None}

    def weigh(self, text: str) -> tuple[float, int]:
        """Summed weight of the matches that no exception covers, and the count of words."""
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for s, w in self.stems.items():
                self._automaton.add_word(f" {s}", (len(s) + 1, w))
            for s in self.exceptions:
                self._automaton.add_word(f" {s} ", (len(s) + 2, None))
            self._automaton.make_automaton()
        folded = fold(text)
        n = folded.count(" ") - 1
        if not len(self._automaton):
            return 0.0, n
        hits, spared = {}, []
        for end, (size, w) in self._automaton.iter(folded):
            start = end - size + 1
            if w is None:
                spared.append((start, end))
            else:  # of stems that begin alike the weightiest counts
                hits[start] = max(hits.get(start, w), w)
        if spared and hits:
            hits = {at: w for at, w in hits.items() if not any(a <= at < b for a, b in spared)}
        return sum(hits.values()), n

    def features(self, text: str) -> tuple[float, float]:
        weight, n = self.weigh(text)
        return math.log1p(weight), math.log1p(100 * weight / max(n, 20))

    def score(self, text: str) -> float:
        a, b, c = self.coefficients
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _stems(word: str):
    yield from (word[:k] for k in range(STEM[0], min(len(word), STEM[1]) + 1))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = (), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Learn from the rows of docs that labels marks 0 or 1; other labels and null ids teach nothing.

    At most sample rows of each label are used. If a label is missing, the model has no lexicon and
    scores every text with the smoothed share of label 1.
    """
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    order = (F.xxhash64("id"), F.col("id"))
    chosen = None
    for y in (0, 1):
        one = marked.filter(F.col("y") == y).orderBy(*order).limit(sample)
        chosen = one if chosen is None else chosen.unionByName(one)
    text = F.coalesce(F.col(text_col), F.lit("")).alias("text")
    rows = docs.select(F.col(id_col).alias("id"), text).join(F.broadcast(chosen), "id").select("y", "text")  # at most 2 * sample rows are broadcast

    def count(batches):
        seen, per = Counter(), Counter()
        for batch in batches:
            for y, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                per[y] += 1
                words = set(fold(t).split())
                seen.update((y, f"{s}*") for s in {s for w in words for s in _stems(w)})
                seen.update((y, w) for w in words if len(w) >= STEM[0])
        for y, n in per.items():
            seen[y, ""] = n
        yield pa.RecordBatch.from_pydict({"s": [s for _, s in seen], "pos": [n * y for (y, _), n in seen.items()], "neg": [n * (1 - y) for (y, _), n in seen.items()]}, schema=pa.schema([("s", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())]))

    counted = rows.mapInArrow(count, "s string, pos long, neg long").groupBy("s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    total = counted.filter("s = ''").first()
    pos, neg = (total.pos, total.neg) if total else (0, 0)
    if not pos or not neg:
        p = (pos + 0.5) / (pos + neg + 1)
        return Model({}, list(exceptions), (math.log(p / (1 - p)), 0.0, 0.0))
    weight = F.log((F.col("pos") + 0.5) / (pos + 1)) - F.log((F.col("neg") + 0.5) / (neg + 1))
    strong = counted.filter("s <> ''").withColumn("w", weight).filter((F.col("pos") >= max(5, SHARE * pos)) & (F.col("w") >= LOG_ODDS) & F.col("s").endswith("*"))
    top = strong.orderBy(F.desc(F.col("pos") * F.col("w")), "s").limit(4 * ENTRIES).collect()
    stems: dict[str, float] = {}
    counts = {r.s[:-1]: r.pos for r in top}
    for r in sorted(top, key=lambda r: len(r.s)):  # a longer stem adds nothing where a shorter one is as good
        s = r.s[:-1]
        if not any(s[:k] in stems for k in range(STEM[0], len(s))) and len(stems) < ENTRIES:
            # the longest stem that as many rows have is the plainer one
            longer = [x for x in counts if x.startswith(s) and counts[x] >= 0.98 * counts[s]]
            stems[max(longer, key=len)] = r.w
    plain = F.lit(False)
    for k in sorted({len(s) for s in stems}):  # one test per length, not one per stem
        plain = plain | F.substring("s", 1, k).isin([s for s in stems if len(s) == k])
    spared = counted.filter(plain & ~F.col("s").endswith("*") & (F.col("neg") >= 2) & (weight < 0)).orderBy(F.desc("neg"), "s").limit(ENTRIES).collect()
    model = Model(stems, [*exceptions, *(r.s for r in spared)], (0.0, 0.0, 0.0))

    def measure(batches):
        for batch in batches:
            f = [model.features(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"y": batch.column(0), "a": pa.array([x for x, _ in f], pa.float64()), "b": pa.array([x for _, x in f], pa.float64())})

    found = rows.mapInArrow(measure, "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])  # at most 2 * sample rows of numbers
    share = marked.agg(F.avg("y")).first()[0]
    y = found["y"].to_numpy(float)
    balance = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    model.coefficients = tuple(float(c) for c in _logistic(found[["a", "b"]].to_numpy(), y, balance))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    c = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (weight * (y - p)) - ridge * c * [0, 1, 1]
        step = np.linalg.solve((x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.diag([0, 1, 1]), grad)
        c += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return c


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with score, double from 0 to 1, of each whole text; null counts as empty, and an empty text gets the score of no match.

    An input column named score is replaced, all others stay; an empty table gives none.
    """
    kept = docs.drop("score")
    at = kept.columns.index(text_col)

    def run(batches):
        f = model.score  # travels with the function: ENTRIES stems and as many exceptions at most
        for batch in batches:
            scores = pa.array([f(t or "") for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "score"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("score", T.DoubleType())]))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null ids count as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n
