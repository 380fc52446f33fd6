"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

No regular expression runs over a text. Each code point has a class; a token's
start depends on the class and on the state that the characters before left,
so a character is a function from state to state. Those functions compose, and
an associative scan over blocks of them gives the state before every character
at once. The resulting byte slices go through pair merging by rank, whose
results are cached; token ends are kept as byte offsets, so that a token can be
found again in the text and a decoded text checked.

The pattern that the automaton stands for: the contractions 's 't 're 've 'm
'll 'd where a token starts with the apostrophe; runs of letters, of numbers or
of other signs, each with one space before it; white space up to the last
before a non-space; white space.

Cases: a null text is empty; an empty text has no ids; a very long text is one
piece of work of linear size, and a very long run that isn't cut is merged with
a heap; repeated rows give equal results; further columns are kept as they are, but
for ones named ids, ends or decoded, which give way.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, spread, table

END, LETTER, NUMBER, OTHER, SHORT, LONG, SPACE, BLANK, WHITE = range(9)
#: States: a token must start; within letters, numbers, other signs; after a leading space; within white space; one or two letters of a contraction to come.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, ONE_MORE, TWO_MORE = range(8)
STATES = 8
BLOCK = 64
#: Characters of text that are scanned at once; a longer text goes alone.
AT_ONCE = 1 << 20


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    nxt, start = np.zeros((9, STATES), np.uint8), np.zeros((9, STATES), bool)
    for s in range(STATES):
        joins = {LETTER: (IN_LETTERS, AFTER_SPACE), NUMBER: (IN_NUMBERS, AFTER_SPACE), OTHER: (IN_OTHER, AFTER_SPACE), SHORT: (IN_OTHER, AFTER_SPACE), LONG: (IN_OTHER, AFTER_SPACE), WHITE: (IN_WHITE,)}
        goes = {END: FRESH, LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, SHORT: ONE_MORE, LONG: TWO_MORE, SPACE: AFTER_SPACE, BLANK: FRESH, WHITE: IN_WHITE}
        for c in range(9):
            start[c, s] = s not in joins.get(c, ())
            nxt[c, s] = goes[c]
            if c in (SHORT, LONG) and not start[c, s]:
                nxt[c, s] = IN_OTHER
            if s == ONE_MORE:
                start[c, s], nxt[c, s] = c == END, FRESH
            elif s == TWO_MORE:
                start[c, s], nxt[c, s] = c == END, ONE_MORE if c != END else FRESH
    return nxt, start


NEXT, START = _automaton()


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    """LETTER, NUMBER, WHITE or OTHER of every code point."""
    cat = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        k = unicodedata.category(chr(cp))[0]
        if k == "L":
            cat[cp] = LETTER
        elif k == "N":
            cat[cp] = NUMBER
    cat[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return cat


def character_classes(cp: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Class of each character; ``ends`` marks the separators between texts."""
    cls = classes()[cp]
    cls[ends] = END
    white = cls == WHITE
    after = np.empty(len(cls), np.uint8)
    after[:-1], after[-1:] = cls[1:], END
    last = white & (after != WHITE) & (after != END)
    cls[last] = np.where(cp[last] == 0x20, SPACE, BLANK)
    at = np.flatnonzero(cp == 0x27)
    at = at[cls[at] == OTHER]
    one = np.zeros(len(at), np.uint32)
    two = np.zeros(len(at), np.uint32)
    has = at + 1 < len(cp)
    one[has] = cp[at[has] + 1]
    has = at + 2 < len(cp)
    two[has] = cp[at[has] + 2]
    cls[at[np.isin(one, [ord(x) for x in "stmd"])]] = SHORT
    long_ = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    cls[at[long_]] = LONG
    return cls


def states_before(maps: np.ndarray, first: int) -> np.ndarray:
    """State before each of n functions (n x STATES) that run one after the other from ``first``."""
    n = len(maps)
    if n <= BLOCK:
        out = np.empty(n, np.uint8)
        for k in range(n):
            out[k] = first
            first = maps[k, first]
        return out
    full = np.tile(np.arange(STATES, dtype=np.uint8), (-(-n // BLOCK) * BLOCK, 1))
    full[:n] = maps
    full = full.reshape(-1, BLOCK, STATES)
    whole = full[:, 0]
    for k in range(1, BLOCK):
        whole = np.take_along_axis(full[:, k], whole, 1)
    state = states_before(whole, first)
    out = np.empty((len(full), BLOCK), np.uint8)
    for k in range(BLOCK):
        out[:, k] = state
        state = np.take_along_axis(full[:, k], state[:, None], 1)[:, 0]
    return out.reshape(-1)[:n]


def token_starts(cls: np.ndarray) -> np.ndarray:
    """Whether a token starts at each character: compose the functions of each block, scan the blocks, go through them."""
    n = len(cls)
    wide = np.full(-(-n // BLOCK) * BLOCK, END, np.uint8)
    wide[:n] = cls
    cols = np.ascontiguousarray(wide.reshape(-1, BLOCK).T)
    flat = NEXT.reshape(-1)
    whole = NEXT[cols[0]]
    for k in range(1, BLOCK):
        whole = flat[(cols[k].astype(np.intp) * STATES)[:, None] + whole]
    state = states_before(whole, FRESH)
    start = np.empty((BLOCK, cols.shape[1]), bool)
    for k in range(BLOCK):
        slot = cols[k].astype(np.intp) * STATES + state
        start[k] = START.reshape(-1)[slot]
        state = flat[slot]
    return start.T.reshape(-1)[:n]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[bytes, int], list[bytes]]:
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    return ranks, tokens


NO_RANK = 1 << 60


@lru_cache(maxsize=2)
def pair_ranks(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ids of the single bytes, ranks of pairs of bytes, and the sorted keys and the ranks of all pairs of tokens that make a token."""
    ranks, tokens = vocabulary(path)
    single = np.array([ranks[bytes([k])] for k in range(256)], np.int64)
    found = [(a * len(tokens) + b, rank) for token, rank in ranks.items() for k in range(1, len(token)) if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None]
    table_ = np.array(sorted(found), np.int64).reshape(-1, 2)
    double = np.full(65536, NO_RANK, np.int64)
    for token, rank in ranks.items():
        if len(token) == 2:
            double[token[0] * 256 + token[1]] = rank
    return single, double, np.append(table_[:, 0], np.iinfo(np.int64).max), np.append(table_[:, 1], NO_RANK)


def merge_many(pieces: list[bytes], path: str) -> list[list[int]]:
    """Ids of many short pieces at once: in each step the pair of lowest rank of every piece, leftmost first, is merged."""
    single, double, keys, ranks = pair_ranks(path)
    size = len(vocabulary(path)[1])
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    wide = int(lengths.max())
    raw = np.zeros((len(pieces), wide), np.uint8)
    there = np.arange(wide) < lengths[:, None]
    raw[there] = np.frombuffer(b"".join(pieces), np.uint8)
    ids = np.where(there, single[raw], -1)
    order = np.where(there[:, 1:], double[raw[:, :-1].astype(np.int64) * 256 + raw[:, 1:]], NO_RANK)
    order = np.concatenate((order, np.full((len(pieces), 1), NO_RANK)), 1)
    rows, out = np.arange(len(pieces)), [None] * len(pieces)

    def rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * size + b
        at = np.searchsorted(keys, key)
        return np.where((keys[at] == key) & (a >= 0) & (b >= 0), ranks[at], NO_RANK)

    column = np.arange(wide)
    while rows.size:
        k = order.argmin(1)
        here = np.arange(len(rows))
        least = order[here, k]
        over = least == NO_RANK
        if over.any():
            for r, x in zip(rows[over].tolist(), ids[over].tolist(), strict=True):
                out[r] = x[: x.index(-1)] if x[-1] == -1 else x
            rows, ids, order, k, least = (x[~over] for x in (rows, ids, order, k, least))
            here = np.arange(len(rows))
            if not rows.size:
                break
        after = np.minimum(column + (column > k[:, None]), wide - 1)
        filled = ids[:, -1] != -1
        ids[here, k] = least
        ids = np.take_along_axis(ids, after, 1)
        ids[filled, -1] = -1
        order = np.take_along_axis(order, np.minimum(column + (column >= k[:, None]), wide - 1), 1)
        nxt = ids[here, np.minimum(k + 1, wide - 1)]
        order[here, k] = np.where(k + 1 < wide, rank(least, nxt), NO_RANK)
        left = k > 0
        order[here[left], k[left] - 1] = rank(ids[here[left], k[left] - 1], least[left])
    return out


def merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same for one piece of any length, with a heap of pairs."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here
    prev, alive = list(range(-1, n - 1)), [True] * n
    heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(piece[k : k + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, k, stop = heapq.heappop(heap)
        mid = end[k]
        if not alive[k] or mid >= n or end[mid] != stop or mid == stop:
            continue
        end[k] = stop
        alive[mid] = False
        if stop < n:
            prev[stop] = k
            if (r := ranks.get(piece[k : end[stop]])) is not None:
                heapq.heappush(heap, (r, k, end[stop]))
        p = prev[k]
        if p >= 0 and (r := ranks.get(piece[p:stop])) is not None:
            heapq.heappush(heap, (r, p, stop))
    out, k = [], 0
    while k < n:
        out.append(ranks[piece[k : end[k]]])
        k = end[k]
    return out


class Encoder:
    """Encodes texts; keeps the ids of pieces it has seen, of at most ``most`` pieces of ordinary length."""

    def __init__(self, path: str, most: int = 200_000):
        self.path = path
        self.ranks, self.tokens = vocabulary(path)
        self.lengths = np.array([len(x) for x in self.tokens], np.int64)
        self.seen: dict[bytes, bytes] = {}
        self.most = most

    def slices(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The texts' bytes joined by NUL, the slices' byte offsets, and how many slices each text has."""
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        start = token_starts(character_classes(cp, ends))
        start[ends] = True
        at = np.flatnonzero(start)
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        place = np.concatenate(([0], np.cumsum(width)))
        per_text = np.diff(np.searchsorted(at, ends), prepend=-1) - 1
        return joined.encode("utf-8", "surrogatepass"), np.append(place[at], place[-1]), per_text

    def learn(self, pieces: set[bytes]) -> dict[bytes, bytes]:
        """Packed ids of the pieces that are too long to be held; those of ordinary length are held from now on."""
        got = {}
        short = []
        for x in pieces:
            if x in self.ranks:
                got[x] = array("i", [self.ranks[x]]).tobytes()
            elif len(x) > 48:
                got[x] = array("i", merge_long(x, self.ranks)).tobytes()
            else:
                short.append(x)
        short.sort(key=len)
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            got.update((x, array("i", ids).tobytes()) for x, ids in zip(part, merge_many(part, self.path), strict=True))
        self.seen.update((x, ids) for x, ids in got.items() if len(x) <= 48)
        return {x: ids for x, ids in got.items() if len(x) > 48}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. Ids of pieces are kept packed, so that a text's are joined without an object per token."""
        data, place, per_text = self.slices(texts)
        bounds = place.tolist()
        pieces = [data[s:e] for s, e in zip(bounds[:-1], bounds[1:], strict=True)]
        known = set(pieces)
        new = known.difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.seen.clear()
            new = known
        long_ = self.learn(new)
        self.seen.update(long_)
        k, out, packed = 0, [], self.seen.__getitem__
        for count in per_text.tolist():
            out.append(np.frombuffer(b"".join(map(packed, pieces[k : k + count])), np.int32))
            k += count + 1
        for piece in long_:
            del self.seen[piece]
        return out

    def ends(self, ids: np.ndarray) -> np.ndarray:
        return np.cumsum(self.lengths[ids])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def portions(texts: list[str]) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for t in texts:
        if held and size + len(t) > AT_ONCE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t) + 1
    if held:
        yield held


def int_lists(lists: list, kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, lists)])
    if ends[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more ids than a batch's offsets can count")
    flat = np.concatenate([np.asarray(x, kind) for x in lists]) if len(lists) else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(kind)))


def encode(df: DataFrame, path: str, text: str = "text", offsets: bool = True, decoded: bool = False) -> DataFrame:
    """df with ``ids`` array<int> and, if asked for, ``ends`` array<long>: the byte offset in the text where each token ends, and ``decoded`` binary, what the ids stand for."""
    df = df.drop("ids", *["ends"] * offsets, *["decoded"] * decoded)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    schema = f"{fields}, ids array<int>" + ", ends array<long>" * offsets + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in field(part, text).to_pylist()]
                ids = [x for held in portions(texts) for x in coder.encode(held)]
                columns = [*part.columns, int_lists(ids, np.int32)]
                names = [*part.schema.names, "ids"]
                if offsets:
                    columns.append(int_lists([coder.ends(x) for x in ids], np.int64))
                    names.append("ends")
                if decoded:
                    columns.append(decode_lists(columns[len(part.columns)], path))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return spread(df).mapInArrow(run, schema)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, where each begins, and its length."""
    tokens = vocabulary(path)[1]
    length = np.array([len(x) for x in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(length) - length, length


def decode_lists(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes that each list of ids stands for: one gather from the vocabulary's bytes for all of them."""
    data, start, length = token_bytes(path)
    ids = lists.flatten().to_numpy(zero_copy_only=False)
    per_list = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    n = length[ids]
    upto = np.cumsum(n)
    place = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(start[ids] - (upto - n), n)
    edges = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(per_list)))]
    if edges[-1] > np.iinfo(np.int32).max:
        raise OverflowError("more bytes than a batch's offsets can count")
    return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data[place])])


def decode(df: DataFrame, path: str) -> DataFrame:
    """df with ``decoded`` binary: the bytes that its ``ids`` stand for (null ids: none)."""
    df = df.drop("decoded")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns, decode_lists(part.column("ids"), path)], names=[*part.schema.names, "decoded"])

    return df.mapInArrow(run, f"{fields}, decoded binary")


#: Fixed value: the pattern that the automaton stands for.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    """The 50k vocabulary; a package whose pattern is another one is refused."""
    import public_tokenizers

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizers' pattern isn't the one that this module's automaton stands for")
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def digests(df: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of what they decode to."""
    coded = encode(df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), path, offsets=False, decoded=True)
    ids = "sha2(array_join(CAST(ids AS array<string>), ','), 256)"
    return coded.selectExpr("doc_id", "CAST(size(ids) AS long) AS n_tokens", f"{ids} AS ids_sha256", "sha2(decoded, 256) AS decoded_sha256")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), default_path())
