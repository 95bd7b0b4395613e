"""Token counts of a byte-level BPE vocabulary by rank-synchronous array merging.

A task takes its texts in bounded blocks and splits them into pre-tokens with array operations on the code
points. The distinct new pre-tokens of a block lie as ragged arrays: one flat array of symbols and the place
where each sequence starts. Each round finds the lowest rank among the neighbours of every sequence, and all
sequences apply their pair at once; a pair that repeats within a sequence is applied at each place, of
overlapping ones at every second. What is left is counted. A new symbol only takes part in pairs of higher
rank than the pair that made it, so the rounds give what the library's queue gives.

Pre-tokens are first cut between two bytes that stand side by side in no vocabulary entry: no merge can
cross there. That keeps sequences short in text without spaces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from threadloom.llm.common import parts, texts_in_small_batches

#: Code points that are split at once; longer texts are cut before a white space that follows another character.
BLOCK = 1 << 20
#: Pre-tokens whose count a worker remembers; longer ones than LONG bytes are counted anew.
KNOWN, LONG = 300_000, 64
#: Symbols that are merged at once, but for a longer single sequence.
MERGED = 1 << 18
NONE = np.iinfo(np.int32).max
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
CUT = re.compile(r"(?<=\S)[ \n]")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Vocabulary:
    """Merge ranks of a byte-level BPE file as sorted arrays; added tokens are whole strings of one token each."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, shape = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        added = spec["added_tokens"]
        if model["type"] != "BPE" or not plain or spec["normalizer"] or shape.get("type") != "ByteLevel" or shape.get("add_prefix_space") or not shape.get("use_regex", True) or any(a[k] for a in added for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: only byte-level BPE without normaliser, prefixes and stripping added tokens is counted by array merging")
        ids = model["vocab"]
        pairs = [tuple(m.split(" ", 1)) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.size = max(ids.values()) + 1
        keys = np.array([ids[a] * self.size + ids[b] for a, b in pairs], np.int64)
        self.order = np.argsort(keys, kind="stable").astype(np.int32)
        self.keys = keys[self.order]
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        of_byte = dict(zip(self._letters(), range(256), strict=True))
        self.symbol = np.zeros(256, np.int32)
        for letter, b in of_byte.items():
            self.symbol[b] = ids[letter]
        self.beside = np.zeros((256, 256), bool)
        for token in ids:
            raw = [of_byte[c] for c in token if c in of_byte]
            if len(raw) == len(token):
                self.beside[raw[:-1], raw[1:]] = True
        whole = sorted((re.escape(a["content"]) for a in added), key=len, reverse=True)
        self.special = re.compile("|".join(whole)) if whole else None
        self.kind = np.zeros(0x110000, np.int8)
        self.split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        Tokenizer.from_file(path)  # the library reads the same file: a broken one fails here, not in a count

    @staticmethod
    def _letters() -> str:
        """The letter that stands for each byte in a vocabulary entry: visible Latin-1 itself, then the letters from 256 on."""
        seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        rest = iter(range(256, 512))
        return "".join(chr(b) if b in seen else chr(next(rest)) for b in range(256))

    def kinds(self, points: np.ndarray) -> np.ndarray:
        """LETTER, NUMBER, SPACE or OTHER of each code point. The library's own splitter is asked once for each new one, as its Unicode version may differ from Python's."""
        found = self.kind[points]
        if not found.all():
            for p in np.unique(points[found == 0]).tolist():
                c = chr(p)
                ends = [e for _, (_, e) in self.split(f"x{c}1")]
                if p == 0x20:
                    self.kind[p] = SPACE
                elif ends == [2, 3]:
                    self.kind[p] = LETTER
                elif ends == [1, 3]:
                    self.kind[p] = NUMBER
                else:
                    self.kind[p] = OTHER if len(self.split(f"!{c}!")) == 1 else SPACE
            found = self.kind[points]
        return found

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of symbols, NONE without one."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], NONE) if len(self.keys) else np.full(len(key), NONE, np.int32)


def starts_of(points: np.ndarray, kind: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Ascending places at which pre-tokens start in points, the texts that start at begins (no empty ones) laid end to end.

    A pre-token is a run of letters, of numbers or of other signs, with one space before it if there is one; a
    run of white space without its last character, which stands alone unless it is a space that goes to what
    follows; or a contraction that starts a run of other signs.
    """
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[begins] = first[n] = True
    run = first.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run.copy()
    blank = kind == SPACE
    last = blank & run[1:] & ~first[1:]  # the last of a run of white space with something after it in its text
    start[:n] |= last
    taken = np.flatnonzero(last & (points == 0x20)) + 1
    start[taken] = False
    # contractions: an apostrophe that starts a run of its own, without a space taken, before s t m d or re ve ll
    at = np.flatnonzero((points == 0x27) & start[:n] & run[1:] & ~first[1:])
    at = at[at + 1 < n]
    if len(at):
        a, b = points[at + 1], points[np.minimum(at + 2, n - 1)]
        inside = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = inside & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))
        for hit, width in ((one, 2), (two & ~one, 3)):
            start[at[hit] + 1] = False
            start[at[hit] + width] = True
    return np.flatnonzero(start[:n])


def merged(vocabulary: Vocabulary, words: list[bytes]) -> np.ndarray:
    """The number of tokens of each word (none empty)."""
    out, lo = np.zeros(len(words), np.int64), 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = size.cumsum()
    while lo < len(words):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MERGED, "right")))
        data = np.frombuffer(b"".join(words[lo:hi]), np.uint8)
        whole = ends[lo:hi] - size[lo:hi] - (ends[lo - 1] if lo else 0)
        free = np.ones(len(data), bool)
        free[1:] = ~vocabulary.beside[data[:-1], data[1:]]
        free[whole] = True
        begins = np.flatnonzero(free)
        left = _survivors(vocabulary, vocabulary.symbol[data], begins)
        out[lo:hi] = np.add.reduceat(left, np.searchsorted(begins, whole))
        lo = hi
    return out


def _survivors(vocabulary: Vocabulary, symbols: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """How many symbols are left of each sequence once no neighbours merge."""
    count = np.diff(begins, append=len(symbols))
    of = np.arange(len(begins))  # the sequence that each of begins belongs to
    follow = np.arange(1, len(symbols) + 1)
    before = np.arange(-1, len(symbols) - 1)
    before[begins] = -1
    follow[np.append(begins[1:], len(symbols)) - 1] = -1
    rank = np.full(len(symbols), NONE, np.int32)
    inner = np.flatnonzero(follow >= 0)
    rank[inner] = vocabulary.ranks(symbols[inner], symbols[inner + 1])
    alive, seq = np.ones(len(symbols), bool), np.repeat(np.arange(len(begins)), count)
    while len(begins):
        low = np.minimum.reduceat(rank, begins)
        going = low < NONE
        if not going.any():
            break
        if 2 * going.sum() < len(going) or 2 * alive.sum() < len(alive):  # keep what can still change, without the symbols that are gone
            keep = alive & going[seq]
            place = keep.cumsum() - 1
            shift = lambda x: np.where(x[keep] >= 0, place[x[keep]], -1)  # noqa: B023, E731
            symbols, rank, follow, before = symbols[keep], rank[keep], shift(follow), shift(before)
            seq = (going.cumsum() - 1)[seq[keep]]
            of, low = of[going], low[going]
            begins, alive = np.searchsorted(seq, np.arange(len(of))), np.ones(len(symbols), bool)
        at = np.flatnonzero((rank == (low[0] if len(low) == 1 else low[seq])) & (rank < NONE))
        chained = np.zeros(len(at), bool)
        chained[1:] = follow[at[:-1]] == at[1:]
        if chained.any():  # a symbol repeated: of overlapping places every second
            head = np.flatnonzero(~chained)
            at = at[(np.arange(len(at)) - np.repeat(head, np.diff(head, append=len(at)))) % 2 == 0]
        gone = follow[at]
        symbols[at] = vocabulary.made[rank[at]]
        alive[gone], rank[gone] = False, NONE
        after = follow[gone]
        follow[at] = after
        has = after >= 0
        before[after[has]] = at[has]
        np.subtract.at(count, of[seq[at]], 1)
        rank[at] = NONE
        a = at[has]
        rank[a] = vocabulary.ranks(symbols[a], symbols[follow[a]])
        a = at[before[at] >= 0]
        rank[before[a]] = vocabulary.ranks(symbols[before[a]], symbols[a])
    return count


class Counter:
    """Counts tokens of texts in a worker; remembers the counts of recent pre-tokens."""

    def __init__(self, path: str):
        self.vocabulary, self.known, self.older = Vocabulary(path), {}, {}

    def pieces(self, text: str) -> Iterator[tuple[str, int]]:
        """Stretches of text that can be split alone, and with nothing of it a 1 for each added token."""
        lo, special = 0, self.vocabulary.special
        for m in special.finditer(text) if special else ():
            yield from ((b, 0) for b in self._blocks(text, lo, m.start()))
            yield "", 1
            lo = m.end()
        yield from ((b, 0) for b in self._blocks(text, lo, len(text)))

    @staticmethod
    def _blocks(text: str, lo: int, hi: int) -> Iterator[str]:
        while hi - lo > BLOCK and (m := CUT.search(text, lo + BLOCK, hi)):
            yield text[lo : m.start()]
            lo = m.start()
        yield text[lo:hi]

    def count(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        held, of, total = [], [], 0
        for i, text in enumerate(texts):
            for piece, ones in self.pieces(text):
                out[i] += ones
                if piece:
                    held.append(piece)
                    of.append(i)
                    total += len(piece)
                    if total >= BLOCK:
                        np.add.at(out, of, self._counted(held))
                        held, of, total = [], [], 0
        if held:
            np.add.at(out, of, self._counted(held))
        return out

    def _counted(self, pieces: list[str]) -> np.ndarray:
        """The number of tokens of each piece (none empty)."""
        body = "".join(pieces)
        points = np.frombuffer(body.encode("utf-32-le"), "<u4")
        begins = np.cumsum([0, *map(len, pieces)])[:-1]
        at = starts_of(points, self.vocabulary.kinds(points), begins)
        raw = body.encode()
        wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        edges = np.append(0, np.cumsum(wide, dtype=np.int64))[np.append(at, len(points))].tolist()
        words = [raw[a:b] for a, b in zip(edges, edges[1:], strict=False)]
        known, older = self.known, self.older
        new = [w for w in set(words) if w not in known]
        seen = [w for w in new if w in older]
        known.update((w, older[w]) for w in seen)
        new = [w for w in new if w not in known] if seen else new
        found = dict(zip(new, merged(self.vocabulary, new).tolist(), strict=True))
        known.update(found)
        counts = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for w in [w for w in new if len(w) > LONG]:
            del known[w]
        if len(known) > KNOWN:
            self.older, self.known = known, {}
        return np.add.reduceat(counts, np.searchsorted(at, begins))


def token_counts(docs: DataFrame, path: str | None = None, limit: int = 1024, text_col: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens, over_limit (more than limit tokens), without the text column: what the tokenizers library counts without special tokens added.

    Null and empty texts have none. The string of an added token within a text is one token, as in the library.
    Input columns named as results are replaced, all others stay; an empty table gives none; repeated rows stay.
    Texts pass through once and are not shuffled; a task holds a block of BLOCK code points or one batch.
    """
    path, docs = path or default_tokenizer(), texts_in_small_batches(docs)
    results = ["n_bytes", "n_tokens", "over_limit"]
    source = docs.drop(*(c for c in results if c != text_col))
    at = source.columns.index(text_col)
    stay = [i for i in range(len(source.columns)) if i != at]

    def run(batches):
        import pyarrow as pa

        counter = Counter(path)
        for batch in batches:
            for part in parts(batch, at, rows=1 << 30):
                texts = part.column(at)
                tokens = counter.count(["" if x is None else x for x in texts.to_pylist()])
                size = pa.compute.binary_length(texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in stay), size, pa.array(tokens), pa.array(tokens > limit)], names=[*(part.schema.names[i] for i in stay), *results])

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())]
    return source.mapInArrow(run, T.StructType([*(source.schema.fields[i] for i in stay), *fields]))
