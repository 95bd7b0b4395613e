"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a hash of the window of eight bytes before a white-space byte has low bits zero, so a
passage that documents share is cut alike in all of them. Chunk digests are counted over the corpus; the
chunks that recur most, up to HOT_BYTES of text, are encoded once and their encodings are broadcast. Any
other chunk is encoded once in a task that meets it, from a bounded memory of its words. Chunk joins are
then checked: the words on both sides are encoded together, and where that disagrees the window is widened
and encoded anew until its outer words agree with the chunks.

The tokenizer must drop white space (no token holds any), as word_bpe_49k.json does; then words are
independent and chunks agree with whole texts, which the tests hold against the library.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.common import parts, texts_in_small_batches

#: One white space in so many ends a chunk (a power of two): about 750 bytes of prose.
CUT_ONE_IN = 128
#: Bytes of shared chunk text that are encoded for all tasks at once, and the rows that are looked at to fill them.
HOT_BYTES, HOT_CHUNKS = 8_000_000, 16_384
#: Encodings that a worker remembers: words, chunks and joins. Older ones are forgotten.
WORDS, CHUNKS, JOINS = 200_000, 4_000, 50_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Memory(dict):
    """A dict that forgets: of two generations of n keys, the older goes."""

    def __init__(self, n: int):
        super().__init__()
        self.n, self.old = n, {}

    def __missing__(self, key):
        self[key] = value = self.old[key]
        return value

    def knows(self, key) -> bool:
        return key in self or key in self.old

    def age(self) -> None:
        if len(self) > self.n:
            self.old = dict(self)
            self.clear()


def cuts(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Ascending offsets in data (uint8) at which chunks begin; starts (of texts) are among them."""
    space = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    at = np.flatnonzero(space)
    at = at[at >= 8]
    if len(at):
        window = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data).data, 0, (1,))[at - 8]
        mixed = (window * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)
        at = at[mixed % np.uint64(CUT_ONE_IN) == 0]
        text = np.searchsorted(starts, at, "right") - 1
        at = at[at - starts[text] >= 8]  # the window lies within the text
    return np.union1d(at, starts)


def chunks(column: pa.Array) -> Iterator[list[bytes]]:
    """The chunks of each text of a string column, in order; null is empty; an empty text has one empty chunk."""
    for part in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        part = part.fill_null("").cast(pa.large_string())
        if not len(part):
            continue
        _, offsets, body = part.buffers()
        bounds = np.frombuffer(offsets, np.int64, len(part) + 1, part.offset * 8)
        raw = memoryview(body)[bounds[0] : bounds[-1]] if body else memoryview(b"")
        bounds = bounds - bounds[0]
        begins = cuts(np.frombuffer(raw, np.uint8), bounds[:-1]) if len(raw) else np.zeros(0, np.int64)
        first = np.searchsorted(begins, bounds)
        edges = begins.tolist()
        for i in range(len(part)):
            lo, hi, end = int(first[i]), int(first[i + 1]), int(bounds[i + 1])
            if bounds[i] == end:
                yield [b""]
            else:
                own = edges[lo:hi]
                yield [bytes(raw[a:b]) for a, b in zip(own, [*own[1:], end], strict=True)]


class Encoder:
    """Encodes chunks in a worker; keeps words, chunks and joins in bounded memory."""

    def __init__(self, path: str, hot: dict[bytes, bytes]):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.hot, self.words, self.chunks, self.joins = hot, Memory(WORDS), Memory(CHUNKS), Memory(JOINS)
        self.names = None

    def raw(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece as little-endian uint32, straight from the library; a few at a time, as its results are large."""
        out = []
        for lo in range(0, len(pieces), 2048):
            found = self.tokenizer.encode_batch_fast([p.decode() for p in pieces[lo : lo + 2048]], add_special_tokens=False)
            out += [np.array(x.ids, "<u4").tobytes() for x in found]
        return out

    def learn(self, words: set[bytes]) -> None:
        new = [w for w in words if not self.words.knows(w)]
        self.words.update(zip(new, self.raw(new), strict=True))

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """UTF-8 of what the library decodes; without a decoder it puts a space between tokens."""
        lists = [np.frombuffer(x, "<u4").tolist() for x in ids]
        if self.tokenizer.decoder is not None:
            return [x.encode() for x in self.tokenizer.decode_batch(lists, skip_special_tokens=False)]
        if self.names is None:
            self.names = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        name = self.names.__getitem__
        return [b" ".join(map(name, x)) for x in lists]

    def encode(self, texts: list[list[bytes]]) -> list[bytes]:
        """Ids of each text, given as its chunks."""
        import xxhash

        digest = xxhash.xxh3_128_digest
        keys = [[digest(c) for c in text] for text in texts]
        todo = {k: c.split() for ks, text in zip(keys, texts, strict=True) for k, c in zip(ks, text, strict=True) if k not in self.hot and not self.chunks.knows(k)}
        self.learn({w for ws in todo.values() for w in ws})
        words, known = self.words, self.chunks
        for k, ws in todo.items():
            known[k] = b"".join([words[w] for w in ws])
        parts = [[self.hot[k] if k in self.hot else known[k] for k in ks] for ks in keys]
        self.mend(texts, parts)
        for m in (self.words, self.chunks, self.joins):
            m.age()
        return [b"".join(p) for p in parts]

    def mend(self, texts: list[list[bytes]], parts: list[list[bytes]]) -> None:
        """Check each join of two chunks on the words beside it, and repair parts where they disagree."""
        sides = lambda a, b: ((a.rsplit(None, 1)[-1:] or [b""])[0], (b.split(None, 1)[:1] or [b""])[0])
        joins = [(i, j, sides(text[j], text[j + 1])) for i, text in enumerate(texts) for j in range(len(text) - 1)]
        new = list({s for _, _, s in joins if not self.joins.knows(s)})
        self.learn({w for s in new for w in s})
        together = self.raw([b" ".join(s) for s in new])
        self.joins.update((s, x == self.words[s[0]] + self.words[s[1]]) for s, x in zip(new, together, strict=True))
        for i, j, s in joins:
            if not self.joins[s]:
                parts[i][j], parts[i][j + 1] = self.repaired(texts[i][j], texts[i][j + 1])

    def repaired(self, a: bytes, b: bytes) -> tuple[bytes, bytes]:
        left, right, width = a.split(), b.split(), 2
        while True:
            x, y = left[-width:], right[:width]
            (ids,) = self.raw([b" ".join(x + y)])
            outer = [self.raw([w])[0] for w in (x[0], y[-1])]
            if ids.startswith(outer[0]) and ids.endswith(outer[1]) or width >= max(len(left), len(right)):
                return b"".join(self.raw([b" ".join(left[:-width])])) + ids, b"".join(self.raw([b" ".join(right[width:])]))
            width *= 2


def _hot(docs: DataFrame, path: str, text_col: str) -> dict[bytes, bytes]:
    """Encodings of the chunks that recur most, by digest. What reaches the driver is bounded by HOT_CHUNKS and HOT_BYTES."""

    def count(batches):
        import xxhash

        for batch in batches:
            seen: dict[bytes, list[int]] = {}
            for text in chunks(batch.column(0)):
                for c in text:
                    seen.setdefault(xxhash.xxh3_128_digest(c), [0, len(c)])[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["k", "n", "size"])

    only = docs.select(F.col(text_col).alias("text"))
    shared = only.mapInArrow(count, "k binary, n long, size long").groupBy("k").agg(F.sum("n").alias("n"), F.max("size").alias("size")).filter("n > 1 AND size > 0")
    top = shared.orderBy(F.desc(F.col("n") * F.col("size")), "k").limit(HOT_CHUNKS).collect()
    wanted, room = set(), HOT_BYTES
    for r in top:
        if r["size"] <= room:
            wanted.add(bytes(r.k))
            room -= r["size"]
    if not wanted:
        return {}
    given = docs.sparkSession.sparkContext.broadcast(wanted)

    def fetch(batches):
        import xxhash

        left = set(given.value)
        for batch in batches:
            got = {}
            for text in chunks(batch.column(0)):
                for c in text:
                    if (k := xxhash.xxh3_128_digest(c)) in left:
                        left.remove(k)
                        got[k] = c
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], names=["k", "chunk"])

    def encode(batches):
        encoder = Encoder(path, {})
        for batch in batches:
            ids = encoder.encode([[c] for c in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["k", "ids"])

    once = only.mapInArrow(fetch, "k binary, chunk binary").groupBy("k").agg(F.first("chunk").alias("chunk"))
    return {bytes(r.k): bytes(r.ids) for r in once.mapInArrow(encode, "k binary, ids binary").collect()}


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", decoded: bool = False, drop_text: bool = False) -> DataFrame:
    """docs with ids, array<int>: the whole text as the tokenizers library encodes it without special tokens added.

    With decoded also decoded: what the library decodes from the ids. drop_text leaves the text column out,
    which spares its way back. Null and empty texts have no ids. A special token's string within a text is
    that token, as in the library. Input columns named as results are replaced, all others stay; an empty
    table gives none.
    """
    path, docs = path or default_tokenizer(), texts_in_small_batches(docs)
    given = docs.sparkSession.sparkContext.broadcast(_hot(docs, path, text_col))
    results = ["ids", "decoded"] if decoded else ["ids"]
    source = docs.drop(*results)
    at = source.columns.index(text_col)
    stay = [i for i, c in enumerate(source.columns) if not (drop_text and i == at)]

    def run(batches):
        encoder = Encoder(path, given.value)
        for batch in batches:
            for part in parts(batch, at):
                found = encoder.encode(list(chunks(part.column(at))))
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                made = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), "<i4"), pa.int32()))]
                if decoded:
                    made.append(pa.array(encoder.decode(found), pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), *made], names=[*(part.schema.names[i] for i in stay), *results])

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    return source.mapInArrow(run, T.StructType([*(source.schema.fields[i] for i in stay), *fields[: len(results)]]))


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """encoded with decoded: what the library's decode(ids, skip_special_tokens=False) gives for ids_col. Null or no ids give ''."""
    path, encoded = path or default_tokenizer(), texts_in_small_batches(encoded)
    kept = encoded.drop("decoded")
    at = kept.columns.index(ids_col)

    def run(batches):
        from tokenizers import Tokenizer

        decode_batch = Tokenizer.from_file(path).decode_batch
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                out = decode_batch([x or [] for x in part.column(at).to_pylist()], skip_special_tokens=False)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.string())], names=[*part.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())]))
