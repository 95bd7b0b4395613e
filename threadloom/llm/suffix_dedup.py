"""Suffix-array dedup of byte strings of LENGTH that occur again anywhere.

A difference cover is a sample of positions that any two equal strings meet at equal offsets. The cover here
depends on content (the anchor of a string is the position of its least hash) in place of residues, which
leaves far less to sort, and since strings are compared over LENGTH bytes only, names need no recursion:

1. Sampled suffixes begin at anchors and are named by their leading bytes, the anchor's hash. A string recurs
   only if its anchor's name does. The strings of one anchor are a block: their starts, and the text that
   they reach over. Blocks of equal text are one, so copies are settled by their count.
2. Within each name that has several blocks, the sampled suffixes are sorted by the bytes from the anchor on,
   and by the bytes before it, and adjacent ones are compared. The remaining suffixes are merged from
   these: at each distance before the anchor, strings of equal lead and equal prefix are one class.
3. A name with more than HOT blocks is not gathered. Its blocks are cut into pieces of WIDTHS distances, and
   the bytes that all strings of a piece share are its name: one that no other piece has is settled, pieces
   of equal text are one, a name with few goes through step 2, and the others are cut again, into single
   strings in the end. So a passage that very many texts hold costs each of them a few rows, not one a string.

Equality rests on bytes in step 2, and on 128-bit digests where blocks or pieces are counted. Several lengths
go together; names and digests of each are apart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.llm.anchors import anchors, gram_hashes
from threadloom.llm.common import discard, materialise, row_key, texts_in_small_batches, unused
from threadloom.llm.shingles import blocks

LENGTH = 400
#: Bytes of text that are searched for anchors together.
BLOCK = 1 << 18
#: A passage has more than so many words and recurs in strings of so many bytes at least, which that many words have in any prose.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 220
#: Blocks of one name that a task holds at once: about 0.6 KB each, and 20 KB more while they are compared.
HOT = 2048
#: Distances that a piece of a block has, which is cut from a block or from a piece of the width before.
WIDTHS = (64, 8, 1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(row_key(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text"))


def _batch(names: list[str], kinds: list, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def found_blocks(texts: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    """row, pos, h, length, near, far, digest: each anchor's position and name, the least and greatest distance of its strings' starts before it, and the digest of the block."""

    def run(batches):
        import xxhash

        names = ["row", "pos", "h", "length", "near", "far", "digest"]
        kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        for batch in batches:
            at = 0
            for whole, bounds in blocks(batch.column(1), BLOCK):
                # a long text goes by pieces of overlapping strings: each string starts in one of them
                for lo in range(0, max(len(whole) - min(lengths) + 1, 1), 2 * BLOCK) if len(whole) > 2 * BLOCK else [0]:
                    piece = np.ascontiguousarray(whole[lo : lo + 2 * BLOCK + max(lengths) - 1] if len(whole) > 2 * BLOCK else whole)
                    hashed, view = gram_hashes(piece), memoryview(piece)
                    for length in lengths:
                        data, edges = (piece[: 2 * BLOCK + length - 1], None) if len(whole) > 2 * BLOCK else (piece, bounds)
                        grams = hashed[: len(hashed) - len(piece) + len(data)] if len(hashed) else hashed
                        pos, h, first, last = anchors(data, np.array([0, len(data)]) if edges is None else edges, length, grams)
                        h = h ^ np.uint64(length * 0x9E3779B97F4A7C15 % 2**64)
                        seeds = (pos - first + (length << 20)).tolist()
                        digests = [xxhash.xxh3_128_digest(view[s:e], x) for x, s, e in zip(seeds, first.tolist(), (last + length).tolist(), strict=True)]
                        text = np.zeros(len(first), np.int64) if edges is None else np.searchsorted(edges, first, "right") - 1
                        rows = batch.column(0).slice(at, len(bounds) - 1).take(pa.array(text))
                        columns = (pos - bounds[text] + lo, h.view(np.int64), np.full(len(pos), length), pos - last, pos - first, digests)
                        yield pa.RecordBatch.from_arrays([rows, *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names=names)
                at += len(bounds) - 1

    return texts.mapInArrow(run, "row binary, pos int, h long, length int, near int, far int, digest binary")


def recurring(leads: list[bytes], suffixes: list[bytes], near: np.ndarray, far: np.ndarray, length: int) -> np.ndarray:
    """For blocks of one name, given by the bytes before the anchor and from it on: whether the string at each distance from 0 to the greatest far recurs among them."""

    def classes(strings: list[bytes], reach: np.ndarray) -> np.ndarray:
        """The class of each string (row) by its first reach[j] bytes (column), from the sorted order and its adjacent prefixes."""
        width = max(1, *map(len, strings))
        table = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
        order = np.argsort(table.view(f"S{width}").ravel(), kind="stable")
        differ = table[order[1:]] != table[order[:-1]]
        common = np.where(differ.any(1), differ.argmax(1), length + 1)
        out = np.zeros((len(strings), len(reach)), np.int64)
        out[order[1:]] = np.cumsum(common[:, None] < reach[None, :], axis=0)
        return out

    d = np.arange(far.max() + 1)
    code = classes([s[::-1] for s in leads], d) * len(leads) + classes(suffixes, length - d)
    valid = (near[:, None] <= d) & (d <= far[:, None])
    code[~valid] = (-1 - np.broadcast_to(np.arange(len(leads))[:, None], code.shape))[~valid]
    order = np.argsort(code, axis=0, kind="stable")
    ranked = np.take_along_axis(code, order, 0)
    same = np.zeros((len(leads) + 1, len(d)), bool)
    same[1:-1] = ranked[1:] == ranked[:-1]
    out = np.zeros(code.shape, bool)
    np.put_along_axis(out, order, same[1:] | same[:-1], 0)
    return out & valid


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist(), strict=True))


_BLOCK = "length int, digest binary, copies long, near int, far int, lead binary, suffix binary"


def _compared(sets: DataFrame, name: str) -> DataFrame:
    """digest, lo, hi: runs of distances at which strings of blocks that are there once recur among the blocks of one name. sets has name, base and _BLOCK; base is added to distances."""

    def compare(batches):
        kinds = [pa.binary(), pa.int32(), pa.int32()]
        held: list[tuple] = []

        def settle():
            length = held[0][2]
            base, _, digests, copies, near, far, leads, suffixes = zip(*{(r[1], r[3]): r[1:] for r in held}.values(), strict=True)
            flags = recurring(list(leads), list(suffixes), np.array(near), np.array(far), length)
            return [(g, b + lo, b + hi) for b, g, c, f in zip(base, digests, copies, flags, strict=True) if c == 1 for lo, hi in _runs(f)]

        out: list[tuple] = []
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[0][0], held[0][2]) != (r[0], r[2]):
                    out += settle()
                    held.clear()
                held.append(r)
            if len(out) > 20_000:
                yield _batch(["digest", "lo", "hi"], kinds, zip(*out, strict=True))
                out = []
        out += settle() if held else []
        if out:
            yield _batch(["digest", "lo", "hi"], kinds, zip(*out, strict=True))

    sets = sets.select(name, "base", "length", "digest", "copies", "near", "far", "lead", "suffix")
    return sets.repartition(name).sortWithinPartitions(name, "length").mapInArrow(compare, "digest binary, lo int, hi int")


def _counted(many: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """As _compared(), for names with any number of blocks, as several tables; and the tables to discard() once these are written. many has length, digest, copies, lo, hi (distances) and body (the text of its strings)."""
    found, made = [], []
    for width in WIDTHS:

        def cut(batches, width=width):
            import xxhash

            names = ["length", "digest", "copies", "lo", "hi", "shared", "whole", "body"]
            kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            for batch in batches:
                for part in range(0, batch.num_rows, 100):
                    out = []
                    for length, digest, copies, near, far, text in zip(*(c.to_pylist() for c in batch.slice(part, 100).columns), strict=True):
                        for base in range(near - near % width, far + 1, width):
                            lo, hi = max(base, near), min(base + width - 1, far)
                            body = text[far - hi : far - lo + length]  # the string at distance d starts at hi - d
                            shared = xxhash.xxh3_128_digest(body[hi - base : max(hi - base - width + 1 + length, 0)], (length << 40) + (base << 20) + width)
                            out.append((length, digest, copies, lo, hi, shared, xxhash.xxh3_128_digest(body, (length << 40) + (lo << 20) + hi), body))
                    if out:
                        yield _batch(names, kinds, zip(*out, strict=True))

        pieces = materialise(many.select("length", "digest", "copies", "lo", "hi", "body").mapInArrow(cut, "length int, digest binary, copies long, lo int, hi int, shared binary, whole binary, body binary"), "pieces")
        # digest is of use where one block has the piece
        firsts = [F.first(c).alias(c) for c in ("shared", "digest", "length", "lo", "hi", "body")]
        kinds = materialise(pieces.groupBy("whole").agg(F.sum("copies").alias("copies"), *firsts), "wholes")
        made += [pieces, kinds]
        again = kinds.filter("copies > 1").select("whole")
        found.append(pieces.filter("copies = 1").join(again, "whole").select("digest", "lo", "hi"))
        names = kinds.groupBy("shared").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        left = kinds.join(names, "shared")
        base = F.col("lo") - F.col("lo") % width
        ahead = F.col("hi") - base
        few = left.filter(F.col("n") <= HOT).select(
            "shared", base.alias("base"), "length", F.when(F.col("copies") == 1, F.col("digest")).otherwise(F.col("whole")).alias("digest"), "copies",
            (F.col("lo") - base).alias("near"), ahead.alias("far"), F.substring("body", F.lit(1), ahead).alias("lead"), F.substring("body", ahead + 1, F.length("body")).alias("suffix"))
        found.append(_compared(few, "shared"))
        many = left.filter(F.col("n") > HOT)
        if width == 1 or many.isEmpty():  # single strings of one name are equal
            break
    return found, made


def repeats(docs: DataFrame, lengths: tuple[int, ...] = (LENGTH,), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (row_key) and for each length a column spans_<length> (array of from, to; maximal, ascending, in UTF-8 bytes), empty if none: one row per row with bytes that a string of a length covers which starts elsewhere too."""
    texts = _texts(texts_in_small_batches(docs), id_col, text_col)
    found = materialise(found_blocks(texts, lengths), "blocks")
    again = materialise(found.groupBy("h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("h"), "again")
    # the digest alone is the key, so that a name with many rows can be split in the join and is pre-aggregated after it
    first = F.min(F.struct("row", "pos")).alias("at")
    kinds = found.join(again, "h").groupBy("digest").agg(*(F.first(c).alias(c) for c in ("h", "length", "near", "far")), F.count(F.lit(1)).alias("copies"), first)
    kinds = materialise(kinds, "kinds")
    names = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    wanted = materialise(kinds.join(names, "h").select("h", "n", "length", "digest", "copies", "near", "far", "at.row", "at.pos"), "wanted")
    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("h", "n", "length", "digest", "copies", "near", "far", "pos")).alias("bs"))

    def fetch(batches):
        names = ["h", "n", "length", "digest", "copies", "near", "far", "lead", "suffix"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            for text, bs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for b in bs:
                    p = b["pos"]
                    out.append((*(b[c] for c in names[:7]), data[p - b["far"] : p], data[p : p - b["near"] + b["length"]]))
                if len(out) > 20_000:
                    yield _batch(names, kinds, zip(*out, strict=True))
                    out = []
            if out:
                yield _batch(names, kinds, zip(*out, strict=True))

    # rows that repeat id and text fetch a block again; it is one by its digest where blocks meet
    rows = texts.join(listed, "row").select("text", "bs")
    fetched = materialise(rows.mapInArrow(fetch, f"h long, n long, {_BLOCK}"), "suffixes")
    compared = _compared(fetched.filter(F.col("n") <= HOT).withColumn("base", F.lit(0)), "h")
    many = fetched.filter(F.col("n") > HOT).dropDuplicates(["digest"])
    counted, made = _counted(many.select("length", "digest", "copies", F.col("near").alias("lo"), F.col("far").alias("hi"), F.concat("lead", "suffix").alias("body")))
    runs = kinds.filter("copies > 1").select("digest", F.col("near").alias("lo"), F.col("far").alias("hi"))
    for more in (compared, *counted):
        runs = runs.unionByName(more)
    runs = materialise(runs.groupBy("digest").agg(F.collect_list(F.struct("lo", "hi")).alias("runs")), "runs")
    hit = found.join(runs, "digest").select("row", "length", F.explode(F.transform("runs", lambda r: F.struct((F.col("pos") - r["hi"]).alias("a"), (F.col("pos") - r["lo"] + F.col("length")).alias("b")))).alias("s"))
    spans = hit.groupBy("row").agg(*(F.collect_set(F.when(F.col("length") == n, F.col("s"))).alias(f"spans_{n}") for n in lengths))

    def merge(batches):
        kind = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
        for batch in batches:
            columns = [batch.column(0)]
            for column in batch.columns[1:]:
                out = []
                for spans in column.to_pylist():
                    merged: list[dict] = []
                    for s in sorted(spans, key=lambda s: s["a"]):
                        if merged and s["a"] <= merged[-1]["b"]:
                            merged[-1]["b"] = max(merged[-1]["b"], s["b"])
                        else:
                            merged.append(s)
                    out.append(merged)
                columns.append(pa.array(out, kind))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = materialise(spans.mapInArrow(merge, ", ".join(["row binary", *(f"spans_{n} array<struct<a: int, b: int>>" for n in lengths)])), "spans")
    discard(found, again, kinds, wanted, fetched, *made, runs)
    return out


def suffix_dedup(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", passages: bool = False) -> DataFrame:
    """docs with n_bytes (long), spans (removed, as repeats() has them) and kept (binary: the remaining bytes).

    With passages also n_passages (long): runs of more than PASSAGE_WORDS words that recur elsewhere in
    strings of PASSAGE_BYTES, also where they are too short to be removed. They are told, not removed.

    Null text is empty. Texts shorter than length lose nothing. Rows that repeat id and text are repeats
    of each other and lose all that length reaches. kept is bytes because a span may begin or end within
    a character. Input columns with these names are replaced, all others stay; an empty table gives none.
    """
    docs = docs.drop("n_bytes", "spans", "kept", *(["n_passages"] if passages else []))
    row, cut_at, told_at = unused(docs, "row", "cut_at", "told_at")
    found = repeats(docs, tuple({length, PASSAGE_BYTES}) if passages else (length,), id_col, text_col)
    spans = found.select(F.col("row").alias(row), F.col(f"spans_{length}").alias(cut_at), *([F.col(f"spans_{PASSAGE_BYTES}").alias(told_at)] if passages else []))
    out = docs.join(spans, row_key(docs[id_col], docs[text_col]) == spans[row], "left").drop(row)
    body = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    out = out.withColumns({"n_bytes": F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long"), "kept": body})
    out = out.withColumn("spans", F.coalesce(cut_at, F.array().cast(T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))))).drop(cut_at)
    at, where = out.columns.index("kept"), out.columns.index("spans")
    told = out.columns.index(told_at) if passages else None

    def cut(batches):
        for batch in batches:
            kept = []
            if told is not None:
                long = [sum(len(bytes(data.as_buffer()[s["a"] : s["b"]]).split()) > PASSAGE_WORDS for s in spans or []) for data, spans in zip(batch.column(at), batch.column(told).to_pylist(), strict=True)]
                batch = batch.set_column(told, told_at, pa.array(long, pa.int64()))
            for data, spans in zip(batch.column(at), batch.column(where).to_pylist(), strict=True):
                data, parts, end = data.as_buffer(), [], 0
                for s in spans:
                    parts.append(memoryview(data)[end : s["a"]])
                    end = s["b"]
                kept.append(b"".join([*parts, memoryview(data)[end:]]) if spans else bytes(data))
            columns = list(batch.columns)
            columns[at] = pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    schema = T.StructType([T.StructField("n_passages", T.LongType()) if f.name == told_at and passages else f for f in out.schema.fields])
    return out.mapInArrow(cut, schema)
