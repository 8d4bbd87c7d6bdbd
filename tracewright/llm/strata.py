"""Ranked lexical search over an index whose documents are grouped by equal length normaliser.

A document's normaliser m is a whole number, so a term has the same impact in all documents of a stratum
(equal m) where it occurs equally often. Postings are therefore kept by stratum and, inside it, by falling
number of occurrences; an impact is computed once for each such run. The first run of a stratum gives the
largest impact there, and the sum over an item's terms bounds the score of every document of the stratum.
Strata are visited in the order of their bounds until the bound falls below the worst score that still counts.

The index is cut into shards of some thousand documents and four million words, each with all its strata, so no stratum, length or
term is larger than a shard. A first wave of shards gives every item a score to beat, which the other shards start with.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.plans.tables import materialize

SHARD_DOCS = 8192
SHARD_WORDS = 1 << 22       # words with repeats, so that long documents do not make larger shards
TERM_BATCH = 1 << 15
ITEM_BLOCK = 512
FIRST_WAVE = 32
_SCALE = 10 ** 9
_INDEX = "shard long, term string, n_docs long, runs binary, docs binary"
_KEPT = set(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz") | set(range(128, 256))
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c in _KEPT else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and all characters above ASCII, in UTF-8 with A-Z in lower case."""
    return text.encode().translate(_TABLE).split() if text else []


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return _SCALE * tf // (1000 * tf + 12 * m)


def forward(docs: DataFrame) -> DataFrame:
    """no_id, d, n (terms with repeats), words (distinct terms), tf, for every document with a term."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, words, tf = [], [], []
            for text in batch["text"]:                  # one table of counts at a time
                c = Counter(terms(text))
                n.append(sum(c.values()))
                words.append(b" ".join(c))
                tf.append(np.fromiter(c.values(), "<u4", len(c)).tobytes())
            yield batch[["no_id", "d"]].assign(n=n, words=words, tf=tf)

    rows = docs.select(F.col("doc_id").isNull().alias("no_id"),
                       F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("d"), F.col("text").alias("text"))
    return rows.mapInPandas(work, "no_id boolean, d long, n long, words binary, tf binary").filter("n > 0")


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


def _slices(raw: bytes, at: np.ndarray, size: int) -> pa.Array:
    """The runs of ``raw`` between neighbours of ``at`` (places of ``size`` bytes), without an object for each."""
    data = raw[size * int(at[0]):size * int(at[-1])]
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((size * (at - at[0])).astype(np.int32)), pa.py_buffer(data)])


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the index of one shard: a head (term null) with strata and ids, then one row for each term."""
    group = pa.Table.from_batches(list(batches))
    shard = group["shard"][0].as_py()
    ms, no_id, ids = group["m"].to_numpy(), group["no_id"].to_numpy(), group["d"].to_numpy()
    order = np.lexsort((ids, no_id, ms))
    words, tfs = group["words"], group["tf"]
    codes, parts, tf = _Codes(), [], []
    for i in order.tolist():
        parts.append(np.fromiter(map(codes.__getitem__, words[i].as_py().split(b" ")), np.int32))
        tf.append(np.frombuffer(tfs[i].as_py(), "<u4"))
    del group, words, tfs
    code, tf = np.concatenate(parts), np.concatenate(tf).astype(np.int64)
    doc = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p) for p in parts])
    m, held = np.unique(ms, return_counts=True)
    stratum = np.repeat(np.arange(len(m), dtype=np.int32), held)[doc]
    sort = np.lexsort((doc, -tf, stratum, code))
    code, tf, stratum, doc = code[sort], tf[sort], stratum[sort], doc[sort].astype("<u2")
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (stratum[1:] != stratum[:-1]) | (tf[1:] != tf[:-1])
    at = np.flatnonzero(new)
    runs = np.stack([stratum[at], tf[at], np.diff(at, append=len(code))], axis=1).astype("<i4").tobytes()
    every = np.arange(len(codes) + 1)
    d_at, r_at = np.searchsorted(code, every), np.searchsorted(code[at], every)
    doc = doc.tobytes()
    names = ["shard", "term", "n_docs", "runs", "docs"]
    head = np.stack([m, held], axis=1).astype("<i8").tobytes()
    numbers = ids[order].astype("<i8").tobytes() + no_id[order].tobytes()
    yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([None], pa.string()), pa.array([len(parts)], pa.int64()),
                           pa.array([head], pa.binary()), pa.array([numbers], pa.binary())], names=names)
    term = list(codes)
    for i in range(0, len(term), TERM_BATCH):
        some = pa.array(term[i:i + TERM_BATCH], pa.string())
        here = slice(i, i + len(some) + 1)
        yield pa.record_batch([pa.array(np.full(len(some), shard, np.int64)), some, pa.array(np.diff(d_at[here]).astype(np.int64)),
                               _slices(runs, r_at[here], 12), _slices(doc, d_at[here], 2)], names=names)


def build_index(docs: DataFrame, shard_docs: int = SHARD_DOCS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The stored index of all documents: shard, term, n_docs, runs (stratum, occurrences, documents), docs (their
    numbers in the shard); rows without a term are the heads of the shards.

    Documents without a term are in no shard. A null id is no reason to leave a document out; repeated rows are
    documents of their own. Empty tables give an empty index; other columns are ignored.
    """
    rows = materialize(forward(docs).withColumn("seq", F.monotonically_increasing_id()), "forward")
    n_docs, length = rows.agg(F.count(F.lit(1)), F.sum("n")).first()
    shards = max(1, -(-n_docs // shard_docs), -(-(length or 0) // shard_words))
    m = F.expr(f"75L + (25L * n * {n_docs}L) div {max(length or 0, 1)}L")
    placed = rows.select("no_id", "d", "words", "tf", m.alias("m"),
                         F.pmod(F.xxhash64("seq"), F.lit(shards)).alias("shard"))
    return materialize(placed.groupBy("shard").applyInArrow(_shard, _INDEX), "strata-index")


class _Term:
    """A term's postings in one shard: the impact of every posting, where each stratum begins, and its best impact."""

    def __init__(self, runs: bytes, docs: bytes, m: np.ndarray):
        s, tf, held = np.frombuffer(runs, "<i4").reshape(-1, 3).astype(np.int64).T
        impact = impacts(tf, m[s])
        first = np.flatnonzero(np.diff(s, prepend=-1))
        self.docs = np.frombuffer(docs, "<u2")
        self.impact = np.repeat(impact, held)
        self.strata, self.best = s[first], impact[first]
        ends = np.concatenate([[0], np.cumsum(held)])
        self.begin = ends[first]
        self.count = np.diff(np.concatenate([self.begin, ends[-1:]]))

    def add(self, score: np.ndarray, weight: int, visited: np.ndarray) -> None:
        """Add the term to the scores of the documents in the visited strata."""
        hit = visited[self.strata]
        if hit.all():
            score[self.docs] += weight * self.impact
            return
        begin, count = self.begin[hit], self.count[hit]
        if len(begin):
            skip = np.concatenate([[0], np.cumsum(count)[:-1]])
            at = np.repeat(begin - skip, count) + np.arange(count.sum())
            score[self.docs[at]] += weight * self.impact[at]


def rank_shard(strata: np.ndarray, query: list[tuple[_Term, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the documents of a shard that were visited, and which of them may be among the k best. ``strata`` has m and
    the number of documents; documents below ``floor`` need not be found."""
    held = strata[:, 1]
    score = np.zeros(held.sum(), np.int64)
    bound = np.zeros(len(held), np.int64)
    for term, weight in query:
        bound[term.strata] += weight * term.best
    order = np.argsort(-bound, kind="stable")
    order = order[bound[order] >= max(floor, 1)]
    least, at, wanted = max(floor, 1), 0, 4 * k
    while at < len(order):
        reach = np.searchsorted(np.cumsum(held[order[at:]]), wanted) + 1
        now = order[at:at + reach]
        now = now[bound[now] >= least]
        if not len(now):
            break
        visited = np.zeros(len(held), bool)
        visited[now] = True
        for term, weight in query:
            term.add(score, weight, visited)
        at, wanted = at + reach, 8 * wanted
        if len(score) > k:
            least = max(least, int(np.partition(score, len(score) - k)[len(score) - k]))
    return score, np.flatnonzero(score >= least)


def _search_group(k: int):
    def work(group: pd.DataFrame) -> pd.DataFrame:
        head = group[group["term"].isna()].iloc[0]
        strata = np.frombuffer(head["runs"], "<i8").reshape(-1, 2)
        n = int(strata[:, 1].sum())
        ids, none = np.frombuffer(head["docs"][:8 * n], "<i8"), np.frombuffer(head["docs"][8 * n:], bool)
        queries: dict[int, list] = {}
        floors: dict[int, int] = {}
        for r in group[group["term"].notna()].itertuples(index=False):
            term = _Term(r.runs, r.docs, strata[:, 0])
            for x in r.items:
                queries.setdefault(x["item"], []).append((term, x["weight"]))
                floors[x["item"]] = x["floor"]
        out = []
        for item, query in queries.items():
            score, found = rank_shard(strata, query, k, floors[item])
            best = found[np.lexsort((ids[found], none[found], -score[found]))[:k]]
            out.append(pd.DataFrame({"item": item, "d": ids[best], "no_id": none[best], "score": score[best]}))
        return pd.concat(out) if out else pd.DataFrame({"item": [], "d": [], "no_id": [], "score": []})

    return work


def _visit(index: DataFrame, asked: DataFrame, blocks: int, k: int) -> DataFrame:
    """item, d, no_id, score of the best documents of each shard of ``index``."""
    heads = index.filter("term is null").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    own = index.filter("term is not null").join(asked.withColumnRenamed("term", "_term"), F.col("term") == F.col("_term"))
    none = F.array().cast(asked.schema["items"].dataType)
    columns = ["shard", "block", "term", "runs", "docs", "items"]
    rows = own.select(*columns).union(heads.withColumn("items", none).select(*columns))
    return rows.groupBy("shard", "block").applyInPandas(_search_group(k), "item long, d long, no_id boolean, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.desc("score"), "no_id", "d")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def item_terms(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered items (item, item_id), and item, term, q (occurrences). Repeated rows count once; several texts of one
    id are one item with the terms of all."""
    @F.pandas_udf("array<string>")
    def cut(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [w.decode() for w in terms(t)])

    rows = items.select(F.col("item_id").alias("item_id"), F.col("text").alias("text")).distinct()
    ids = materialize(rows.select("item_id").distinct().withColumn("item", F.monotonically_increasing_id()), "items")
    found = rows.select("item_id", F.explode(cut(F.coalesce("text", F.lit("")))).alias("term"))
    counted = found.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("q"))
    named = ids.withColumnRenamed("item_id", "_id")
    return ids, counted.join(named, F.col("item_id").eqNullSafe(F.col("_id"))).select("item", "term", "q")


def search(index: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every item (item_id, text) with a score above 0, equal
    scores by ascending doc_id, null ids last.

    A term weighs floor(1000 ln((2 N + 2) / (2 df + 1))). Null or empty texts of items find nothing; neither does an empty index.
    """
    ids, counted = item_terms(items)
    counted = materialize(counted, "item-terms")
    n_docs, shards = index.filter("term is null").agg(F.sum("n_docs"), F.count(F.lit(1))).first()
    n_items = ids.count()
    blocks, n_docs = max(1, -(-n_items // ITEM_BLOCK)), n_docs or 0
    known = counted.select(F.col("term").alias("_term")).distinct()
    df = (index.filter("term is not null").select("term", "n_docs").join(known, F.col("term") == F.col("_term"))
          .groupBy("term").agg(F.sum("n_docs").alias("df")))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    weighted = counted.join(df, "term").select(F.pmod(F.xxhash64("item"), F.lit(blocks)).alias("block"), "item", "term",
                                               (weight * F.col("q")).alias("weight"))
    weighted = materialize(weighted.filter("weight > 0"), "weighted-terms")

    def asked(floors: Column, rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy("block", "term").agg(F.collect_list(F.struct(
            "item", "weight", floors.alias("floor"))).alias("items")), "asked")

    first = F.col("shard") < -(-(shards or 0) // FIRST_WAVE)
    zero = F.lit(0).cast("long")
    start = materialize(_best(_visit(index.filter(first), asked(zero, weighted), blocks, k), k), "first-wave")
    floors = start.filter(F.col("rank") == k).select(F.col("item").alias("_item"), F.col("score").alias("_floor"))
    beaten = weighted.join(floors, F.col("item") == F.col("_item"), "left")
    rest = _visit(index.filter(~first), asked(F.coalesce("_floor", zero), beaten), blocks, k)
    best = _best(start.drop("rank").unionByName(rest), k)
    return best.join(ids, "item").select("item_id", "rank", F.when(~F.col("no_id"), F.col("d")).alias("doc_id"), "score")
