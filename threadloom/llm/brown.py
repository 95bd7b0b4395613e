"""LM scoring with a Brown class-based bigram model.

Every token is a unit: each word that training has LEAST times or more by itself, any other by its last
three bytes, if that ending is among the ENDINGS most frequent, or else the one remaining unit. Bigrams of
units are counted over the whole training text, and exchange clustering moves each unit to the class under
which these counts are likeliest, all units of one half in a round; a round that lowers the objective is taken back, and rounds end when they gain less than GAIN. Then
P(word | previous) = P(class | previous class) * P(word | class), the first by counts of class bigrams that
shrink to the class's share, the second by (c + 0.5) / (N + 0.5 * (V + 1)) within the class, so unknown
words have a share of every class.

Units are told by 64-bit hashes of their words, so a task holds nine bytes for each, its class with it; the
neighbours of each unit stay in a table. Words are cut, hashed and looked up a megabyte of text at a time, as Arrow arrays. Counts of all words stay in a table. The HEAD most frequent go to
every task; of the others, which are counted over all data as well, the words of each document meet their
counts in a join.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.llm.common import materialise, parts, row_key, texts_in_small_batches
from threadloom.llm.shingles import _FOLD, _SPACE

ENDINGS, CLASSES = 500, 48
#: The exchange ends when a round of each half has gained less than this share of the objective, after so many halvings of what moves at once, or after so many rounds.
GAIN, SHARES, ROUNDS = 0.001, 3, 30
#: A word that training has so often is a unit by itself.
LEAST = 5
#: Words whose counts are sent to every task: at most so many rows of a word and a number.
HEAD = 150_000
#: Weight of the class's share against its class bigrams, in tokens.
SHRINK = 5.0
END = b""


def tokens(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased, then one end."""
    return [*(text or "").encode().lower().split(), END]


def hashes(words: list[bytes]) -> np.ndarray:
    """As Spark's xxhash64."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(w, 42) for w in words], np.uint64).view(np.int64)


def split(column: pa.Array) -> tuple[pa.BinaryArray, np.ndarray]:
    """The tokens() of all texts of the column in a row, and how many of them each text has."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, body = column.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[bounds[0] : bounds[-1]] if body else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    solid = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=solid[1:-1])
    first = np.zeros(len(data) + 1, bool)  # texts begin here
    first[bounds] = True
    starts = np.flatnonzero(solid[1:-1] & (~solid[:-2] | first[:-1]))
    ends = np.flatnonzero(solid[1:-1] & (~solid[2:] | first[1:])) + 1
    until = np.searchsorted(starts, bounds[1:])
    length = np.insert(ends - starts, until, 0)
    at = np.zeros(len(length) + 1, np.int32)
    np.cumsum(length, out=at[1:])
    words = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(at), pa.py_buffer(_FOLD[data[solid[1:-1]]])])
    return words, np.diff(until, prepend=0) + 1


def _bytes(words: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of words (any 8 after them), and where each word begins (and the end)."""
    _, offsets, body = words.buffers()
    at = np.frombuffer(offsets, np.int32, len(words) + 1, words.offset * 4).astype(np.int64) if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(body, np.uint8)[at[0] : at[-1]] if body else np.zeros(0, np.uint8)
    return np.concatenate((data, np.zeros(8, np.uint8))), at - at[0]


def word_keys(words: pa.BinaryArray) -> np.ndarray:
    """hashes() of words, all at once."""
    import xxhash

    p1, p2, p3, p4, p5 = (np.uint64(p) for p in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    data, bounds = _bytes(words)
    eights = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    at, left = bounds[:-1].copy(), np.diff(bounds)
    h = np.uint64(42) + p5 + left.astype(np.uint64)
    long = np.flatnonzero(left >= 32)
    for _ in range(3):
        i = np.flatnonzero(left >= 8)
        h[i] = turned(h[i] ^ turned(eights[at[i]] * p2, 31) * p1, 27) * p1 + p4
        at[i] += 8
        left[i] -= 8
    i = np.flatnonzero(left >= 4)
    h[i] = turned(h[i] ^ (eights[at[i]] & np.uint64(0xFFFFFFFF)) * p1, 23) * p2 + p3
    at[i] += 4
    left[i] -= 4
    for k in range(3):
        i = np.flatnonzero(left > k)
        h[i] = turned(h[i] ^ data[at[i] + k] * p5, 11) * p1
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    h ^= h >> np.uint64(32)
    for i in long.tolist():
        h[i] = xxhash.xxh64_intdigest(data[bounds[i] : bounds[i + 1]].tobytes(), 42)
    return h.view(np.int64)


def place(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Where each key stands among the known ones, which ascend; -1 if it does not."""
    if not len(known):
        return np.full(len(keys), -1)
    order = np.argsort(keys)  # neighbours are looked for after one another
    at = np.minimum(np.searchsorted(known, keys[order]), len(known) - 1)
    out = np.empty(len(keys), np.int64)
    out[order] = np.where(known[at] == keys[order], at, -1)
    return out


def _tails(words: pa.BinaryArray) -> np.ndarray:
    """A number of each word's last three bytes, or of all if there are fewer."""
    data, bounds = _bytes(words)
    end, n = bounds[1:], np.minimum(np.diff(bounds), 3)
    out = n << 24
    for k in range(3):
        out += np.where(n > k, data[np.maximum(end - 1 - k, 0)].astype(np.int64) << 8 * k, 0)
    return out


class Units:
    """Maps words to units, of which words gives the hashes, the end's first."""

    def __init__(self, words: np.ndarray, endings: list[bytes]):
        self.order = np.argsort(words)
        self.sorted = words[self.order]
        tails = _tails(pa.array(endings, pa.binary()))
        self.by_tail = np.argsort(tails)
        self.tails = tails[self.by_tail]
        self.plain = len(words)
        self.size = len(words) + len(endings) + 1

    def of(self, words: list[bytes]) -> list[int]:
        return self.find(pa.array(words, pa.binary())).tolist()

    def find(self, words: pa.BinaryArray, keys: np.ndarray | None = None) -> np.ndarray:
        """The unit of each word; keys are its word_keys(), if known."""
        at = place(word_keys(words) if keys is None else keys, self.sorted)
        out = np.where(at >= 0, self.order[at], self.size - 1)
        rest = np.flatnonzero(at < 0)
        if len(rest):
            tail = place(_tails(words.take(pa.array(rest))), self.tails)
            out[rest[tail >= 0]] = self.plain + self.by_tail[tail[tail >= 0]]
        out[np.diff(_bytes(words)[1]) == 0] = 0  # the end
        return out


@dataclass
class Model:
    words: np.ndarray  # hashes, by unit
    endings: list[bytes]
    classes: np.ndarray  # by unit
    transitions: np.ndarray  # log10, previous class by class
    denominators: np.ndarray  # log10, by class
    head: dict[bytes, int]  # counts of the most frequent words
    total: int
    distinct: int
    counts: DataFrame | None = None  # w, c of all words


#: Tokens that a task of word_counts() sums before it hands them on.
COUNTED = 1_000_000


def word_counts(train: DataFrame) -> DataFrame:
    """w (bytes), c: every token of train(text), the end too."""

    def run(batches):
        held, n = [], 0
        for batch in batches:
            for part in parts(batch, 0):
                held.append(split(part.column(0))[0])
                n += len(held[-1])
                if n > COUNTED:
                    yield counted(held)
                    held, n = [], 0
        if held:
            yield counted(held)

    def counted(held):
        words, c = pa.concat_arrays(held).value_counts().flatten()
        return pa.RecordBatch.from_arrays([words, c], names=["w", "c"])

    return train.mapInArrow(run, "w binary, c long").groupBy("w").agg(F.sum("c").alias("c"))


def packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose row i holds the numbers values[bounds[i] : bounds[i + 1]]; bytes reach Python as one block, arrays number by number."""
    ends = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(values))])


def unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """values and bounds of a column of packed() that holds numbers of this kind."""
    if not len(column):
        return np.zeros(0, kind), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    bounds = np.frombuffer(ends, np.int32, len(column) + 1, column.offset * 4).astype(np.int64) // np.dtype(kind).itemsize
    lo, hi = int(bounds[0]), int(bounds[-1])
    values = np.frombuffer(data, kind, hi - lo, lo * np.dtype(kind).itemsize) if hi > lo else np.zeros(0, kind)
    return values, bounds - lo


#: Pairs of one unit that a task of neighbours() holds before it sums equal ones, and tokens whose pairs it sums before the shuffle.
FOLD, SUMMED = 4_000_000, 4_500_000


def neighbours(train: DataFrame, words: np.ndarray, endings: list[bytes]) -> DataFrame:
    """unit, half, after, after_n, before, before_n: of each unit how often each other unit follows and precedes it. A text's first token follows an end.

    after and before are packed() int32 units, after_n and before_n packed() int64 counts; half splits the units in two.
    Every SUMMED tokens of a task are summed by pair before the shuffle, and a unit's sums go as one row, so a frequent
    unit's list stays below the number of units.
    """
    given = train.sparkSession.sparkContext.broadcast((words, endings))

    def pairs(batches):
        units = Units(*given.value)

        def counted(u):
            key = u[:-1].astype(np.int64)
            key *= units.size
            key += u[1:]
            key, n = np.unique(key, return_counts=True)
            u, v, n = (key // units.size).astype(np.int32), (key % units.size).astype(np.int32), n.astype(np.int32)
            back = np.argsort(v)
            for side, unit, other, k in ((0, u, v, n), (1, v[back], u[back], n[back])):
                first = np.flatnonzero(np.diff(unit, prepend=-1))
                bounds = np.append(first, len(unit))
                yield pa.RecordBatch.from_arrays([pa.array(unit[first]), pa.array(np.full(len(first), side, np.int8)), packed(other, bounds), packed(k, bounds)], names=["unit", "side", "other", "n"])

        rows, n = [np.zeros(1, np.int32)], 0
        for batch in batches:
            for part in parts(batch, 0):
                coded = split(part.column(0))[0].dictionary_encode()
                rows.append(units.find(coded.dictionary).astype(np.int32)[coded.indices.to_numpy()])
                n += len(rows[-1])
                if n > SUMMED:
                    yield from counted(np.concatenate(rows))
                    rows, n = rows[:1], 0
        yield from counted(np.concatenate(rows))

    def gather(batches):
        def fold(kept):
            key, n = (np.concatenate(x) for x in zip(*kept, strict=True))
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            return key[first], np.add.reduceat(n[order].astype(np.int64), first)

        def made(key, n):
            unit, other, back = key >> 33, (key & 0xFFFFFFFF).astype(np.int32), (key >> 32 & 1).astype(bool)
            own = unit[np.flatnonzero(np.diff(unit, prepend=-1))]
            columns = [pa.array(own, pa.int32()), pa.array((own * 2654435761 >> 7) % 2, pa.int8())]
            for side in (~back, back):
                bounds = np.append(np.searchsorted(unit[side], own), side.sum())
                columns += [packed(other[side], bounds), packed(n[side], bounds)]
            return pa.RecordBatch.from_arrays(columns, names=["unit", "half", "after", "after_n", "before", "before_n"])

        kept: list[tuple[np.ndarray, np.ndarray]] = []  # of the unit that the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            unit, side = (batch.column(i).to_numpy().astype(np.int64) for i in (0, 1))
            (other, bounds), (n, _) = (unpacked(batch.column(i), np.int32) for i in (2, 3))
            key = np.repeat(unit * 2 + side << 32, np.diff(bounds)) | other
            cut = int(bounds[np.searchsorted(unit, unit[-1])])
            if kept and (cut or kept[0][0][0] >> 33 != unit[0]):
                yield made(*fold([*kept, (key[:cut], n[:cut])]))
                kept = []
            elif cut:
                yield made(*fold([(key[:cut], n[:cut])]))
            kept.append((key[cut:], n[cut:]))
            if sum(len(k) for k, _ in kept[1:]) > max(FOLD, len(kept[0][0])):
                kept = [fold(kept)]
        if kept:
            yield made(*fold(kept))

    found = train.mapInArrow(pairs, "unit int, side byte, other binary, n binary").repartition("unit").sortWithinPartitions("unit")
    return found.mapInArrow(gather, "unit int, half byte, after binary, after_n binary, before binary, before_n binary")


def _by_class(other: pa.Array, n: pa.Array, of: np.ndarray, classes: int) -> np.ndarray:
    """A row per unit: the sums of its counts n by the class of the other unit."""
    (other, bounds), (n, _) = unpacked(other, np.int32), unpacked(n, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1) * classes, np.diff(bounds))
    return np.bincount(row + of[other], n, (len(bounds) - 1) * classes).reshape(-1, classes)


def class_bigrams(near: DataFrame, of: np.ndarray, classes: int) -> np.ndarray:
    given = near.sparkSession.sparkContext.broadcast(of)

    def run(batches):
        total, of = np.zeros(classes * classes), given.value
        for batch in batches:
            (other, bounds), (n, _) = unpacked(batch.column(1), np.int32), unpacked(batch.column(2), np.int64)
            own = np.repeat(of[batch.column(0).to_numpy()].astype(np.int64) * classes, np.diff(bounds))
            total += np.bincount(own + of[other], n, classes * classes)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"u": pa.array(at // classes, pa.int32()), "v": pa.array(at % classes, pa.int32()), "n": pa.array(total[at].astype(np.int64))})

    table = np.zeros((classes, classes))
    found = near.select("unit", "after", "after_n").mapInArrow(run, "u int, v int, n long")
    for x in found.groupBy("u", "v").agg(F.sum("n").alias("n")).collect():  # classes squared at most
        table[x.u, x.v] = x.n
    return table


def best_classes(table: np.ndarray, own: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The likeliest class of each unit by the class bigrams without it; own, after and before have a row per unit."""
    # the table without the unit differs in the row and the column of its own class only
    i, half = np.arange(len(own)), 0.5
    logs = np.log(table + half)
    row = np.maximum(table[own] - after, 0) + half
    column = np.maximum(table[:, own].T - before, 0) + half
    row[i, own] = column[i, own] = np.maximum(table[own, own] - after[i, own] - before[i, own], 0) + half
    got = after @ logs.T + before @ logs
    got += after[i, own, None] * (np.log(column) - logs[:, own].T) + before[i, own, None] * (np.log(row) - logs[own])
    got[i, own] = (after * np.log(row)).sum(1) + (before * np.log(column)).sum(1)
    leaving = (table + half).sum(1) - (table[:, own].T + half) + column
    leaving[i, own] = row.sum(1)
    entering = (table + half).sum(0) - (table[own] + half) + row
    entering[i, own] = column.sum(1)
    return (got - after.sum(1, keepdims=True) * np.log(leaving) - before.sum(1, keepdims=True) * np.log(entering)).argmax(1)


def objective(table: np.ndarray) -> float:
    """The log-likelihood (natural) of class bigrams under the transitions that they make themselves, half a bigram added to each."""
    t = table + 0.5
    return float((t * np.log(t)).sum() - (t.sum(1) * np.log(t.sum(1))).sum() - (t.sum(0) * np.log(t.sum(0))).sum())


def exchange(near: DataFrame, size: int, classes: int = CLASSES, rounds: int = ROUNDS, gain: float = GAIN) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, the class bigrams, and the objective after each round. near is of neighbours(), with units below size; the driver holds some bytes a unit.

    Each round sums every unit's bigrams by the class on the other side and finds its best class, with the other
    units where they were. One half moves at a time. Moves that are good one by one can be bad together, so the
    objective is computed from the new bigrams: a round that lowers it is taken back, and from then on half as many
    units, chosen by a hash of unit and round, move at once. So the objective never falls from one kept state to
    the next. The rounds end when two kept rounds running, one of each half, have gained less than gain of the objective
    together, when so few move that SHARES halvings have passed, or after rounds.
    """
    of = np.minimum(np.arange(size), classes - 1).astype(np.uint8 if classes <= 256 else np.int32)  # the most frequent units begin with a class of their own
    table = class_bigrams(near, of, classes)
    told, share, last = [objective(table)], 1.0, []
    for r in range(rounds):
        given = near.sparkSession.sparkContext.broadcast(of)

        def move(batches, table=table, given=given):
            for batch in batches:
                for lo in range(0, batch.num_rows, 2048):
                    unit, *sides = batch.slice(lo, 2048).columns
                    after, before = (_by_class(*side, given.value, classes) for side in (sides[:2], sides[2:]))
                    new = best_classes(table, given.value[unit.to_numpy()], after, before)
                    yield pa.RecordBatch.from_arrays([unit, pa.array(new, pa.int32())], names=["unit", "class"])

        turn = near.filter(F.col("unit") >= classes) if r == 0 else near.filter(F.col("half") != r % 2) if r > 1 else near
        moved = turn.drop("half").mapInArrow(move, "unit int, class int").toArrow()  # a row per unit
        given.destroy()
        unit, new = moved["unit"].to_numpy().astype(np.int64), moved["class"].to_numpy()
        if share < 1:
            some = (unit * 2654435761 + r * 40503 >> 9) % 1024 < share * 1024
            unit, new = unit[some], new[some]
        tried = of.copy()
        tried[unit] = new
        found = table if (tried == of).all() else class_bigrams(near, tried, classes)
        value = objective(found)
        if value < told[-1]:
            share /= 2
            told.append(told[-1])
            last = []
            if share < 0.5**SHARES:
                break
            continue
        last = [*last[-1:], value - told[-1]]
        of, table = tried, found
        told.append(value)
        if r > 1 and len(last) == 2 and sum(last) <= gain * abs(value):
            break
    return of, table, told


def _most_frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """At most so many of the most frequent words, cut where counts change by a sixteenth of their binary logarithm, so nothing is sorted."""
    step = F.floor(F.log2("c") * 16).cast("int")
    seen, least = 0, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # a row per step
        if seen + r.n > most:
            break
        seen, least = seen + r.n, r.step
    if least is None:
        return {}
    found = counts.filter(step >= least).toArrow()
    return dict(zip(found["w"].to_pylist(), found["c"].to_pylist(), strict=True))


def fit(train: DataFrame, head: int = HEAD, units: int | None = None, endings: int = ENDINGS, classes: int = CLASSES, rounds: int = ROUNDS, text_col: str = "text") -> Model:
    """The model of all texts of train; null texts count as empty. Without rows it knows no word and has one class.

    units limits the words that are units by themselves to the most frequent; by default all that occur LEAST times are.
    """
    train = texts_in_small_batches(train).select(F.col(text_col).alias("text"))
    counts = materialise(word_counts(train), "word_counts")
    n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    if not n:
        return Model(hashes([END]), [], np.zeros(2, int), np.zeros((1, 1)), np.log10([0.5]), {}, 0, 0, counts)
    known = _most_frequent(counts, head)
    others = counts.filter(F.col("w") != F.lit(END)).withColumn("h", F.xxhash64("w"))
    if units is None:
        frequent, seldom = others.filter(F.col("c") >= LEAST), others.filter(F.col("c") < LEAST)
    else:
        frequent = others.orderBy(F.desc("c"), "w").limit(units)
        seldom = others.join(F.broadcast(frequent.select("w")), "w", "left_anti")
    top = frequent.select("h", "c").toArrow()  # 16 bytes a word
    h, c = (top[x].to_numpy() for x in ("h", "c"))
    h = h[np.lexsort((h, -c))]
    words = np.concatenate((hashes([END]), h[h != hashes([END])[0]]))
    tails = seldom.groupBy(F.expr("substring(w, -3, 3)").alias("e")).agg(F.sum("c").alias("c")).orderBy(F.desc("c"), "e").limit(endings)
    ends = [bytes(r.e) for r in tails.collect()]
    near = materialise(neighbours(train, words, ends), "neighbours")
    of, table, _ = exchange(near, len(words) + len(ends) + 1, classes, rounds)
    given = train.sparkSession.sparkContext.broadcast((words, ends, of))

    def spread(batches):
        known = Units(*given.value[:2])
        tokens_of, words_of = np.zeros(classes), np.zeros(classes)
        for batch in batches:
            c = given.value[2][known.find(batch.column(0))]
            tokens_of += np.bincount(c, batch.column(1).to_numpy(), classes)
            words_of += np.bincount(c, minlength=classes)
        yield pa.RecordBatch.from_pydict({"class": pa.array(range(classes), pa.int32()), "n": pa.array(tokens_of.astype(np.int64)), "v": pa.array(words_of.astype(np.int64))})

    held = np.zeros((2, classes))
    for r in counts.mapInArrow(spread, "class int, n long, v long").groupBy("class").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect():
        held[:, r["class"]] = r.n, r.v
    share = (held[0] + 0.5) / (held[0] + 0.5).sum()
    transitions = np.log10((table + SHRINK * share) / (table.sum(1, keepdims=True) + SHRINK))
    return Model(words, ends, of, transitions, np.log10(held[0] + 0.5 * (held[1] + 1)), known, int(n), int(v), counts)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (row_key), n_tokens, n_known, base_score (unigrams), score (the model's log10 probability): one row per row of docs.

    Null text is empty: the end alone. Rows that repeat id and text get the same figures. An empty table gives an empty result.
    """
    docs = texts_in_small_batches(docs)
    top = pa.array(list(model.head), pa.binary())
    order = np.argsort(word_keys(top))
    head = (word_keys(top)[order], np.log10(np.array(list(model.head.values()), float)[order] + 0.5), top.take(pa.array(order)))
    given = docs.sparkSession.sparkContext.broadcast((model.words, model.endings, model.classes, model.transitions, model.denominators, head))
    base = np.log10(model.total + 0.5 * (model.distinct + 1))

    def run(batches):
        words, endings, classes, transitions, denominators, head = given.value
        units, end = Units(words, endings), classes[0]
        keys, logs_of, top = head
        for batch in batches:
            for part in parts(batch, 2):
                words, length = split(part.column(2))
                coded = words.dictionary_encode()
                names, at = coded.dictionary, coded.indices.to_numpy()
                hashed = word_keys(names)
                c = classes[units.find(names, hashed)]
                spot = place(hashed, keys)
                known = np.full(len(names), -1.0)  # log10 of the count, or -1 for a word out of the head
                met = np.flatnonzero(spot >= 0)
                met = met[pa.compute.equal(names.take(pa.array(met)), top.take(pa.array(spot[met]))).to_numpy(zero_copy_only=False)]
                known[met] = logs_of[spot[met]]
                first = np.cumsum(length) - length
                to = c[at]
                before = np.concatenate(([end], to[:-1]))
                before[first] = end
                path = np.add.reduceat(transitions[before, to] - denominators[to], first)
                logs = known[at]
                inside = logs >= 0
                # of every text the words out of the head, each once with its number
                outside = np.flatnonzero(~inside)
                key, k = np.unique(np.repeat(np.arange(len(length)), length)[outside] * len(names) + at[outside], return_counts=True)
                bounds = np.searchsorted(key, np.arange(len(length) + 1) * len(names))
                rare = pa.StructArray.from_arrays([names.take(pa.array(key % len(names))), pa.array(k, pa.int64())], names=["w", "k"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(length, pa.int64()), pa.array(np.add.reduceat(inside.astype(np.int64), first)), pa.array(np.add.reduceat(np.where(inside, logs, 0.0), first)), pa.array(path), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), rare)],
                    names=["doc_id", "row", "n_tokens", "n_head", "shared", "own", "rare"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("doc_id"), row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))
    done = materialise(slim.mapInArrow(run, f"doc_id {kind}, row binary, n_tokens long, n_head long, shared double, own double, rare array<struct<w: binary, k: long>>"), "scored")
    # rows that repeat id and text have the same rare words; one of them stands for all
    rare = done.groupBy("row").agg(F.first("rare").alias("rare")).select("row", F.inline("rare"))
    met = rare.join(model.counts, "w", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * F.log10(F.coalesce("c", F.lit(0)) + 0.5)).alias("logs"))
    known = F.col("shared") + F.coalesce("logs", F.lit(0.0))
    return done.drop("rare").join(met, "row", "left").select(
        "doc_id", "row", "n_tokens", (F.col("n_head") + F.coalesce("more", F.lit(0))).alias("n_known"),
        (known - F.col("n_tokens") * F.lit(float(base))).alias("base_score"), (known + F.col("own")).alias("score"))
