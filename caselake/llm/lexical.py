"""Ranked lexical search: posting lists cut into blocks of similar documents, blocks skipped by exact summary bounds.

Documents are sharded; a shard of up to ``PER_SHARD`` documents is indexed and searched in one task.
In a shard every term has a posting list. A list is cut geometrically into blocks of about ``PER_POSTINGS``
documents: some of its documents are drawn as centres, and each document joins the centre that its
vector of weighted terms (in a random projection) is most like. A block's summary is the
coordinatewise maximum over its documents of each term's contribution before weighting.

An item's terms are visited in descending order of the most that their list
can add. A block is skipped only where its summary's score for the item, an upper bound for each
of its documents, lies below the k-th best score so far; the documents of other blocks
are scored exactly. Visiting stops when all further lists together can't reach the k-th
best score, as what they hold and earlier lists don't can't either. Blocks of a list are made
and summarised when the first item opens it, which most lists of very frequent terms never see
(one pass of all items meets a shard, and the shard's index is dropped after it). All
arithmetic is integer, so bounds are exact and the result is that of scoring everything.

Scale: one pass counts the items' terms in all documents (raw UTF-8 bytes, no regular expression), the corpus
statistics are two small aggregates, and each shard returns k rows for each item.
The items' vocabulary travels to the tasks, so items are taken in groups by a hash of their text, each of about
``VOCABULARY`` bytes at most; more items mean more groups, each reading the documents again.

Cases: a null text has no terms; documents without any item's term still count in N and L; a null doc_id
ranks after others of its score; of documents that repeat an id each is one
document; items without terms, or whose terms all weigh 0, give no row; items
that repeat id and text count once, and texts that share an id are answered together as one list of
k rows; very long texts are read whole; an empty table of documents or items gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, spread, table

K, PER_SHARD, PER_POSTINGS, SKETCH, VOCABULARY = 10, 8192, 64, 32, 32 << 20
#: Entries of summaries that a task holds at once; lists beyond are made again when an item opens them.
SUMMARIES = 8 << 20
#: Of the bytes of UTF-8: letters and digits of ASCII (A-Z lower-cased) and all beyond ASCII stay, the others part terms.
FOLD = bytes(b + 32 if chr(b).isupper() and b < 128 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """The stored forward index: doc_id, n (terms with repeats), terms and tfs (of the terms in ``numbers`` only)."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            n, terms, tfs = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                words = terms_of(text)
                n.append(len(words))
                found = {number[w]: c for w, c in Counter(words).items() if w in number}
                terms.append(list(found))
                tfs.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], names=["doc_id", "n", "terms", "tfs"])

    rows = docs.selectExpr("CAST(doc_id AS long) AS doc_id", "CAST(text AS string) AS text")
    return cut(spread(rows).mapInArrow(run, "doc_id long, n long, terms array<int>, tfs array<long>"))


class Shard:
    """Some documents' contributions (document by document in ``term`` and ``gain``), and the blocks of the lists that were opened."""

    def __init__(self, ids: np.ndarray, start: np.ndarray, term: np.ndarray, gain: np.ndarray, weights: np.ndarray):
        self.ids, self.start, self.term, self.gain, self.weights = ids, start, term, gain, weights
        self.doc = np.repeat(np.arange(len(ids)), np.diff(start))
        order = np.argsort(term, kind="stable")
        self.lists, self.ends = self.doc[order], np.searchsorted(term[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        np.maximum.at(self.most, term, gain)
        towards = np.random.default_rng(45).standard_normal((len(weights), SKETCH)).astype(np.float32)
        self.sketch = np.zeros((len(ids), SKETCH), np.float32)
        pull = (self.weights[term] * gain).astype(np.float32)
        for c in range(SKETCH):
            self.sketch[:, c] = np.bincount(self.doc, pull * towards[term, c], len(ids))
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-30)
        self.opened: dict[int, tuple[np.ndarray, ...]] = {}

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the documents' contributions, and the place in ``docs`` of each."""
        size = self.start[docs + 1] - self.start[docs]
        at = np.repeat(np.arange(len(docs)), size)
        return np.repeat(self.start[docs] - np.cumsum(size) + size, size) + np.arange(len(at)), at

    def blocks(self, t: int) -> tuple[np.ndarray, ...]:
        """The list of t: documents by block, first of each block (and the end), and the summaries: block, term, greatest gain."""
        if t not in self.opened:
            docs = self.lists[self.ends[t] : self.ends[t + 1]]
            centres = docs[np.random.default_rng(t).permutation(len(docs))[: -(-len(docs) // PER_POSTINGS)]]
            near = (self.sketch[docs] @ self.sketch[centres].T).argmax(1)
            order = np.argsort(near, kind="stable")
            docs, near = docs[order], near[order]
            first = np.flatnonzero(np.diff(near, prepend=-1))
            block = np.cumsum(np.diff(near, prepend=-1) != 0) - 1
            entry, at = self.entries(docs)
            # block, term and gain (below 2^20) in one number: sorted, the last of each block and term is the greatest
            both = np.sort((block[at] * len(self.weights) + self.term[entry]) << 20 | self.gain[entry])
            last = np.flatnonzero(np.diff(both >> 20, append=-1))
            of, gain = both[last] >> 20, both[last] & (1 << 20) - 1
            self.opened[t] = docs, np.append(first, len(docs)), (of // len(self.weights)).astype(np.int32), (of % len(self.weights)).astype(np.int32), gain.astype(np.int32)
            while len(self.opened) > 1 and sum(len(x[-1]) for x in self.opened.values()) > SUMMARIES:
                del self.opened[next(iter(self.opened))]
        return self.opened[t]

    def search(self, terms: np.ndarray, k: int) -> list[tuple[int | None, int]]:
        """The k best (row of the shard, score) above 0; equal scores by id, a null id last (``ids`` are ranks)."""
        w = self.weights[terms] * (self.most[terms] > 0)
        terms, able = terms[w > 0], (self.weights[terms] * self.most[terms])[w > 0]
        order = np.argsort(-able, kind="stable")
        terms, rest = terms[order], np.append(np.cumsum(able[order][::-1])[::-1], 0)
        of_item = np.zeros(len(self.weights), np.int64)
        of_item[terms] = self.weights[terms]
        seen = np.zeros(len(self.ids), bool)
        best_row, best_score, floor = np.empty(0, np.int64), np.empty(0, np.int64), 0
        for i, t in enumerate(terms):
            if rest[i] < floor:
                break
            docs, first, block, term, gain = self.blocks(int(t))
            bound = np.bincount(block, of_item[term] * gain, len(first) - 1).astype(np.int64)
            ahead = np.argsort(-bound, kind="stable")
            step = 1
            while ahead.size:
                go, ahead = ahead[:step], ahead[step:]
                go = go[bound[go] >= floor]
                if not go.size:
                    break  # the others' bounds are lower
                there = np.concatenate([docs[first[b] : first[b + 1]] for b in go])
                there = there[~seen[there]]
                seen[there] = True
                if there.size:
                    entry, at = self.entries(there)
                    score = np.bincount(at, of_item[self.term[entry]] * self.gain[entry], len(there)).astype(np.int64)
                    best_row, best_score = np.append(best_row, there), np.append(best_score, score)
                    top = np.lexsort((self.ids[best_row], -best_score))[:k]
                    best_row, best_score = best_row[top], best_score[top]
                    if len(top) == k:
                        floor = int(best_score[-1])
                step = min(2 * step, 64)
        return list(zip(best_row.tolist(), best_score.tolist(), strict=True))


def shards(batches: Iterator[pa.RecordBatch], per_shard: int) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, per_shard):
            held.append(batch.slice(at, per_shard))
            if sum(b.num_rows for b in held) >= per_shard:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def search_group(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], k: int, per_shard: int) -> DataFrame:
    """(item, doc_id, score): the k best documents of each shard for each of the numbered items."""
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    rows = counted(docs, numbers)
    total = rows.filter("n > 0").agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    df = dict(rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
    n, length = total["n"], total["l"] or 1
    weights = np.array([weight(n, df[t]) if t in df else 0 for t in range(len(numbers))], np.int64)
    asked = [np.array(sorted(numbers[t] for t in set(terms)), np.int64) for _, terms in items]
    sent = rows.sparkSession.sparkContext.broadcast((weights, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, asked = sent.value
        for tab in shards(batches, per_shard):
            column = tab.column("terms").combine_chunks()
            tfs = tab.column("tfs").combine_chunks().flatten().to_numpy()
            start = column.offsets.to_numpy().astype(np.int64)
            start -= start[0]
            m = 100 - 90 + (90 * tab.column("n").to_numpy() * n) // length
            gain = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(start)))
            shown = tab.column("doc_id").combine_chunks()
            ranks = pc.fill_null(shown, np.iinfo(np.int64).max).to_numpy()
            shard = Shard(ranks, start, column.flatten().to_numpy().astype(np.int64), gain, weights)
            found = [(i, r, s) for i, terms in enumerate(asked) for r, s in shard.search(terms, k)]
            if found:
                item, row, score = (np.array(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(item), shown.take(pa.array(row)), pa.array(score)], names=["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item long, doc_id long, score long")


def rank(docs: DataFrame, items: DataFrame, k: int = K, per_shard: int = PER_SHARD, vocabulary: int = VOCABULARY) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best of docs (doc_id, text) for each of items (item_id, text)."""
    asked = items.selectExpr("CAST(item_id AS long) AS item_id", "CAST(text AS string) AS text").filter("text IS NOT NULL").dropDuplicates()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = -(-size // vocabulary)
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for g in range(groups):
        own = asked.filter(f"pmod(xxhash64(text), {groups}) = {g}").orderBy("item_id", "text").collect()
        texts = [(r["item_id"], terms_of(r["text"].encode())) for r in own]
        texts = [(i, t) for i, t in texts if t]
        if not texts:
            continue
        best = search_group(docs, texts, k, per_shard)
        ids = docs.sparkSession.createDataFrame([(n, i) for n, (i, _) in enumerate(texts)], "item long, item_id long")
        best = best.withColumn("nth", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))).filter(F.col("nth") <= k)
        out = out.unionByName(best.join(ids, "item").select("item_id", F.col("nth").alias("rank"), "doc_id", "score"))
    # texts that share an id share its k places
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "rank")
    return out.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate({0}.text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_TERMS.format("documents")} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*)::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM d WHERE len(t) > 0),
q AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest({_TERMS.format("benchmark")}) AS term FROM benchmark)),
p AS (SELECT doc_id, r, n, term, count(*)::BIGINT AS tf FROM (SELECT doc_id, r, len(t)::BIGINT AS n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * max(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY term),
g AS (SELECT doc_id, r, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS part FROM p JOIN w USING (term), c),
s AS (SELECT item_id, doc_id, r, sum(part)::BIGINT AS score FROM q JOIN g USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 10"""
