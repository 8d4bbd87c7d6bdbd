"""Language-model scores of documents with a trie of all n-grams of the training texts.

Back-off model of order 3 with modified Kneser-Ney discounts, estimated from the counts of
counts: a kept n-gram has (count - discount) / count of its context, any other the back-off
weight of the context times the probability one order down. The unigrams are add-one
estimates. All pairs and triples are kept; a caller may raise ``least``, and the mass of those that go is then part of the
back-off weights.

Counting: every task sorts the n-grams of some million tokens and sends one coded run of distinct keys to each shard; a
shard is a range of keys, with bounds taken from the running counts of the order below, so that a
frequent context is spread over several shards. A shard merges its runs and writes its level file. Scoring
opens the level files through memory maps; nothing is broadcast but their names and first keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from tracewright.llm import blobfile
from tracewright.llm.elias_fano import EliasFano
from tracewright.llm.trie import (HASH_BITS, BOW_ONE, Level, Vocabulary, bow_code, make_filter, probability_code,
                                   write_shard)
from tracewright.plans.tables import discard, materialize, shuffles_deleted
from tracewright.session import scratch_path


@dataclass(frozen=True)
class TrieRule:
    """``least``: smallest kept counts of orders 2 and 3. The sizes bound what a task holds and do not change results."""
    least: tuple[int, int] = (1, 1)
    shard_words: int = 1 << 20
    shard_grams: int = 1 << 21
    chunk_tokens: int = 1 << 20
    memo_words: int = 600_000


@dataclass
class Model:
    vocabulary: Vocabulary
    level2: Level
    level3: Level
    discounts: list[list[float]] = field(default_factory=list)


def _hashes(ws: Iterable[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_digest
    raw = np.frombuffer(b"".join([digest(w) for w in ws]), ">u8").astype(np.uint64)
    return raw >> np.uint64(64 - HASH_BITS)


# --- level 1 -------------------------------------------------------------------------------------------------

def _split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, as ``common.words`` cuts them, and where each text begins among them (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    parts = lists.flatten()
    real = pc.not_equal(parts, "")                       # blanks at the ends leave empty parts
    kept = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    edges = lists.offsets.to_numpy().astype(np.int64)
    return parts.filter(real).cast(pa.binary()), kept[edges - edges[0]]


def _listed(words_: pa.Array) -> list[bytes]:
    return words_.to_numpy(zero_copy_only=False).tolist()          # much faster than to_pylist


def _pieces(batch: pa.RecordBatch, limit: int) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in pieces whose texts have about ``limit`` bytes."""
    sizes = pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = int(total[start - 1]) if start else 0
        stop = max(start, int(np.searchsorted(total, before + limit, "left"))) + 1
        yield batch.slice(start, stop - start)
        start = stop


def build_vocabulary(docs: DataFrame, folder: str, rule: TrieRule) -> Vocabulary:
    """``docs``: text, train. Words are identified by a 63-bit hash."""
    flush = rule.memo_words // 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, n, ends = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.append(h, -1)), pa.array(np.append(n, ends))], ["h", "n"])

        for batch in batches:
            for piece in _pieces(batch.filter(batch.column("train")), 4 * rule.chunk_tokens):
                found = _split_words(piece.column("text"))[0].value_counts()
                ends += piece.num_rows
                h = np.concatenate([h, _hashes(_listed(found.field("values"))).astype(np.int64)])
                n = np.concatenate([n, found.field("counts").to_numpy()])
                h, back = np.unique(h, return_inverse=True)
                n = np.bincount(back, n, len(h)).astype(np.int64)
                if len(h) > flush:
                    yield rows()
                    h, n, ends = h[:0], n[:0], 0
        yield rows()

    table = materialize(docs.select("text", "train").mapInArrow(count, "h long, n long").groupBy("h")
                        .agg(F.sum("n").alias("n")), "words")
    real = F.col("h") >= 0
    stats = table.agg(F.count(F.when(real, 1)).alias("words"), F.sum(F.when(real, F.col("n"))).alias("tokens"),
                      F.sum(F.when(~real, F.col("n"))).alias("ends")).first()
    bits = max(0, int(np.ceil(np.log2(max(stats["words"], 1) / rule.shard_words))))
    width = HASH_BITS - bits

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("h")
        h, cum = group["h"].to_numpy(np.uint64), np.concatenate([[0], np.cumsum(group["n"].to_numpy(np.int64))])
        path = f"{folder}/words-{uuid.uuid4().hex}"
        write_shard(path, {"hash": (h & np.uint64((1 << width) - 1), 1 << width), "cum": (cum, int(cum[-1]) + 1)})
        return pd.DataFrame({"shard": [int(h[0]) >> width], "path": [path], "n": [len(h)], "total": [int(cum[-1])]})

    shard = F.shiftright("h", width) if bits else F.lit(0).cast("long")
    made = (table.filter(real).withColumn("shard", shard).groupBy("shard")
            .applyInPandas(write, "shard long, path string, n long, total long").toPandas().sort_values("shard"))
    discard(table)
    sizes, totals = made["n"].tolist(), made["total"].tolist()
    return Vocabulary(bits, made["shard"].tolist(), made["path"].tolist(), _before(sizes), _before(totals),
                      sum(sizes), sum(totals), int(stats["ends"] or 0))


def _before(sizes: list[int]) -> list[int]:
    return [0, *np.cumsum(sizes).tolist()][:len(sizes)]


class WordNumbers:
    """Numbers and unigram log10 probabilities of words, with a bounded memory of words seen before."""

    def __init__(self, vocabulary: Vocabulary, limit: int):
        self._vocabulary, self._limit = vocabulary, limit
        self._forget()

    def _forget(self) -> None:
        self._slots: dict[bytes, int] = {}
        self._ids, self._logs = np.zeros(0, np.int32), np.zeros(0)

    def learn(self, texts: list[list[bytes]]) -> None:
        if len(self._slots) > self._limit:
            self._forget()
        seen: set[bytes] = set()
        for ws in texts:
            seen.update(ws)
        new = list(seen.difference(self._slots))
        hashes = _hashes(new)
        order = np.argsort(hashes)
        ids, counts = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        ids[order], counts[order] = self._vocabulary.lookup(hashes[order])
        base = len(self._slots)
        self._slots.update(zip(new, range(base, base + len(new))))
        self._ids = np.concatenate([self._ids, ids.astype(np.int32)])
        self._logs = np.concatenate([self._logs, self._vocabulary.log_probability(counts)])

    def get(self, ws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(map(self._slots.__getitem__, ws), np.int64, len(ws))
        return self._ids[at], self._logs[at]


def encode(docs: DataFrame, vocabulary: Vocabulary, rule: TrieRule) -> DataFrame:
    """doc_id, train, n_tokens, n_known, base_score, ids (little-endian 32-bit, the end last; unknown words -1)."""
    if vocabulary.words >= 2 ** 31 - 2:
        raise ValueError("more than 2**31 distinct words: widen the stored numbers")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = WordNumbers(vocabulary, rule.memo_words)
        end_log = float(vocabulary.log_probability(np.array(vocabulary.ends)))
        for batch in batches:
            for piece in _pieces(batch, 2 * rule.chunk_tokens):
                ws, edges = _split_words(piece.column("text"))
                coded = ws.dictionary_encode()
                distinct, at = _listed(coded.dictionary), coded.indices.to_numpy()
                numbers.learn([distinct])
                ids, logs = (v[at] for v in numbers.get(distinct))
                base = [float(logs[a:b].sum()) + end_log for a, b in zip(edges[:-1], edges[1:])]
                known = np.diff(np.concatenate([[0], np.cumsum(ids >= 0)])[edges]) + (vocabulary.ends > 0)
                sizes = np.diff(edges)
                stored = np.full(len(ids) + len(sizes), vocabulary.words, "<i4")         # the last of a text is the end
                stored[np.arange(len(ids)) + np.repeat(np.arange(len(sizes)), sizes)] = ids
                offsets = 4 * (edges + np.arange(len(edges)))
                packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [
                    None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(stored)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), piece.column("train"), pa.array(sizes + 1), pa.array(known.astype(np.int64)),
                     pa.array(base, pa.float64()), packed], ["doc_id", "train", "n_tokens", "n_known", "base_score", "ids"])

    return docs.select("doc_id", "train", "text").mapInArrow(
        work, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, ids binary")


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["doc_id"] = pd.array([None if pd.isna(r[0]) else int(r[0]) for r in rows], "Int64")
    return out


def _chunks(batches: Iterator[pd.DataFrame], columns: list[str], size: Callable, limit: int) -> Iterator[list[tuple]]:
    """Rows in lists whose sizes add up to about ``limit``."""
    held, total = [], 0
    for batch in batches:
        for row in zip(*(batch[c].tolist() for c in columns)):
            held.append(row)
            total += size(row)
            if total >= limit:
                yield held
                held, total = [], 0
    if held:
        yield held


# --- levels 2 and 3 ------------------------------------------------------------------------------------------

def _small(counts: np.ndarray) -> dict[str, np.ndarray]:
    big = np.flatnonzero(counts > 254)
    return {"c": np.minimum(counts, 255).astype(np.uint8), "big": big.astype(np.int64), "big_c": counts[big].astype(np.int64)}


def _large(arrays: dict[str, np.ndarray]) -> np.ndarray:
    out = arrays["c"].astype(np.int64)
    out[arrays["big"]] = arrays["big_c"]
    return out


def _coded_run(keys: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> bytes:
    base = int(keys[0])
    return blobfile.to_bytes({"base": np.array([base], np.int64), "code": codes, **_small(counts), **blobfile.prefixed(
        EliasFano.encode((keys - base).astype(np.uint64), int(keys[-1]) - base + 1), "keys")})


def _runs(keys: np.ndarray, codes: np.ndarray | None, bounds: np.ndarray) -> pd.DataFrame:
    """Distinct keys with counts, as one coded run per shard."""
    if codes is None:
        distinct, counts = np.unique(keys, return_counts=True)
        codes = np.zeros(len(distinct), np.uint8)
    else:
        distinct, first, counts = np.unique(keys, return_index=True, return_counts=True)
        codes = codes[first]
    shard = np.searchsorted(bounds, distinct, "right")
    edges = np.searchsorted(shard, np.arange(len(bounds) + 2))
    rows = [(k, _coded_run(distinct[a:b], counts[a:b], codes[a:b]))
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
    return pd.DataFrame(rows, columns=["shard", "run"])


def pair_runs(table: DataFrame, vocabulary: Vocabulary, symbols: int, bounds: np.ndarray, rule: TrieRule) -> DataFrame:
    end = vocabulary.words

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _chunks(batches, ["ids"], lambda r: len(r[0]) // 4, rule.chunk_tokens):
            ids = np.frombuffer(b"".join(r[0] for r in held), "<i4").astype(np.int64)
            inside = ids[:-1] != end
            yield _runs((ids[:-1] * symbols + ids[1:])[inside], None, bounds)

    return table.filter("train").select("ids").mapInPandas(work, "shard long, run binary")


def triple_runs(table: DataFrame, symbols: int, bounds: np.ndarray, rule: TrieRule) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for held in _chunks(batches, ["pair", "rel", "code"], lambda r: len(r[2]), rule.chunk_tokens):
            pair, rel, code = _joined(held)
            yield _runs(pair * symbols + rel, code, bounds)

    return table.filter("train").select("pair", "rel", "code").mapInPandas(work, "shard long, run binary")


def _joined(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(b"".join(r[0] for r in held), "<i4").astype(np.int64),
            np.frombuffer(b"".join(r[1] for r in held), "<i4").astype(np.int64),
            np.frombuffer(b"".join(r[2] for r in held), np.uint8))


def mass_bounds(at_mass: Callable, total: int, symbols: int, symbol_at: Callable, rule: TrieRule) -> np.ndarray:
    """First keys of the shards but the first one: even shares of the counts of the contexts, and
    inside a context even shares of what ``symbol_at`` (share in 0..1, context) says of the symbols."""
    out = []
    for i in range(1, -(-total // rule.shard_grams)):
        mass = i * rule.shard_grams
        ctx, before, count = at_mass(mass)
        out.append(ctx * symbols + symbol_at(min(max((mass - before) / max(count, 1), 0.0), 1.0), ctx))
    return np.unique(np.array(out, np.int64))


SHARD = ("path string, shard long, n long, n1 long, n2 long, n3 long, n4 long, total long, first_ctx long, first_sym long, "
         "last_ctx long, most long, first array<double>, last array<double>")


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def build_level(runs: DataFrame, folder: str, symbols: int, least: int, step: float, context_counts: Callable,
                lower: Callable | None, lower_step: float) -> tuple[Level, list[float], int]:
    """Merge the runs of each shard and write the level. ``context_counts`` gives the counts of sorted
    contexts, ``lower`` the log10 probabilities of symbols one order down (None: the codes
    of the runs have them, in steps of ``lower_step``). Also returns the discounts and the largest number of
    successors of a context."""
    def coded(code: np.ndarray) -> np.ndarray:
        return (10.0 ** (-lower_step * np.arange(256.0)))[code]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        keys, counts, codes = [], [], []
        for raw in group["run"]:
            arrays = blobfile.from_bytes(raw)
            keys.append(EliasFano(blobfile.group(arrays, "keys")).values().astype(np.int64) + int(arrays["base"][0]))
            counts.append(_large(arrays))
            codes.append(arrays["code"])
        distinct, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        n = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
        code = np.concatenate(codes)[first]
        kinds = [int((n == i).sum()) for i in (1, 2, 3, 4)]
        on = n >= least
        distinct, n, code = distinct[on], n[on], code[on]
        shard = int(group["shard"].iloc[0])
        if not len(n):
            return pd.DataFrame([("", shard, 0, *kinds, 0, 0, 0, 0, 0, [], [])], columns=_columns(SHARD))
        ctx, sym = distinct // symbols, distinct % symbols
        if lower is None:
            q, kept = coded(code), {"code": code}
        else:
            each, back = np.unique(sym, return_inverse=True)
            q = (10.0 ** lower(each))[back]
            kept = {"q": q.astype(np.float32)}
        path = f"{folder}/raw-{uuid.uuid4().hex}"
        base = int(ctx[0]) * symbols
        write_shard(path, {"keys": ((distinct - base).astype(np.uint64), (int(ctx[-1]) - int(ctx[0]) + 1) * symbols)},
                    **kept, **_small(n))
        starts = np.flatnonzero(np.diff(ctx, prepend=-1))
        sizes = np.diff(np.append(starts, len(ctx)))

        def sums(a: int, b: int) -> list[float]:
            part = n[a:b]
            return [float(b - a), float(part.sum()), *(float((part == i).sum()) for i in (1, 2)),
                    float((part > 2).sum()), float(q[a:b].sum())]

        return pd.DataFrame([(path, shard, len(n), *kinds, int(n.sum()), int(ctx[0]), int(sym[0]), int(ctx[-1]),
                              int(sizes.max()), sums(0, int(sizes[0])), sums(int(starts[-1]), len(ctx)))],
                            columns=_columns(SHARD))

    spark = runs.sparkSession
    found = runs.groupBy("shard").applyInPandas(merge, SHARD).toPandas().sort_values("shard", ignore_index=True)
    n1, n2, n3, n4 = (int(found[c].sum()) for c in ("n1", "n2", "n3", "n4"))
    d = discounts(n1, n2, n3, n4)
    found = found[found["n"] > 0].reset_index(drop=True)
    # contexts that lie in several shards: their sums are put together here, one row per shard
    whole: dict[int, np.ndarray] = {}
    leads, most = [], int(found["most"].max()) if len(found) else 0
    for k, row in found.iterrows():
        before = whole.get(row["first_ctx"])
        leads.append(int(before[0]) if before is not None else 0)
        whole[row["first_ctx"]] = np.array(row["first"]) + (0 if before is None else before)
        if row["last_ctx"] != row["first_ctx"]:
            whole[row["last_ctx"]] = np.array(row["last"])
    most = max([most, *(int(s[0]) for s in whole.values())])
    level = Level(symbols, step, [], *(found[c].tolist() for c in ("first_ctx", "first_sym", "last_ctx")),
                  _before(found["n"].tolist()), leads, _before(found["total"].tolist()),
                  int(found["n"].sum()), int(found["total"].sum()))
    if not len(found):
        return level, d, most

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                raw = blobfile.read_arrays(row.path)
                n = _large(raw)
                q = np.asarray(coded(raw["code"]).astype(np.float32) if lower is None else raw["q"], float)
                key = EliasFano(blobfile.group(raw, "keys")).values().astype(np.int64)
                width = row.last_ctx - row.first_ctx + 1
                ctx = key // symbols
                starts = np.flatnonzero(np.diff(ctx, prepend=-1))
                present = ctx[starts]
                sizes = np.diff(np.append(starts, len(ctx)))
                total = context_counts(present + row.first_ctx).astype(float)
                taken = n - _discount(n, d)
                p = taken / np.repeat(total, sizes)
                p_sum, q_sum = np.add.reduceat(taken, starts) / total, np.add.reduceat(q, starts)
                for at, s in ((0, row.first_sums), (-1, row.last_sums)):
                    p_sum[at] = (s[1] - s[2] * d[0] - s[3] * d[1] - s[4] * d[2]) / total[at]
                    q_sum[at] = s[5]
                bow = np.full(width, BOW_ONE, np.uint8)
                bow[present] = bow_code(np.log10(np.maximum(1 - p_sum, 1e-6) / np.maximum(1 - q_sum, 1e-6)))
                pointers = np.concatenate([[0], np.cumsum(np.bincount(present, sizes, width).astype(np.int64))])
                path = f"{folder}/level-{uuid.uuid4().hex}"
                write_shard(path, {"keys": (key.astype(np.uint64), width * symbols), "ptr": (pointers, len(n) + 1),
                                   "cum": (np.concatenate([[0], np.cumsum(n)]), int(n.sum()) + 1)},
                            prob=probability_code(np.log10(p), step), bow=bow, filter=make_filter(key.astype(np.uint64)))
                yield pd.DataFrame({"shard": [row.shard], "path": [path]})

    work = found[["path", "shard", "first_ctx", "last_ctx"]].assign(
        first_sums=[whole[c].tolist() for c in found["first_ctx"]], last_sums=[whole[c].tolist() for c in found["last_ctx"]])
    table = spark.createDataFrame(work, "path string, shard long, first_ctx long, last_ctx long, "
                                        "first_sums array<double>, last_sums array<double>")
    done = table.repartition(len(found), "shard").mapInPandas(finish, "shard long, path string").toPandas()
    level.paths = done.sort_values("shard")["path"].tolist()
    for path in found["path"]:
        blobfile.delete(path)
    return level, d, most


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.replace(", ", ",").split(",")]


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off counts 1, 2 and above, from the numbers of n-grams with count 1 to 4."""
    if not (n1 and n2):
        return [0.75, 0.75, 0.75]
    y = n1 / (n1 + 2.0 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [float(np.clip(x, 0.05, k - 0.05)) for k, x in enumerate(raw, 1)]


def with_pairs(table: DataFrame, vocabulary: Vocabulary, level: Level, rule: TrieRule) -> DataFrame:
    """The documents with their score under the pairs, as far as it is final, and what triples may
    change: pair (position of the pair before a word), rel (number of the word among the
    successors), code (its probability), and lone (pairs before a word without a pair)."""
    end, symbols = vocabulary.words, level.symbols

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["doc_id", "train", "n_tokens", "n_known", "base_score", "ids"]
        for held in _chunks(batches, columns, lambda r: r[2], rule.chunk_tokens):
            ids = np.frombuffer(b"".join(r[5] for r in held), "<i4").astype(np.int64)
            has = np.flatnonzero((ids[:-1] != end) & (ids[:-1] >= 0))           # words with a context, less 1
            key = ids[has] * symbols + np.where(ids[has + 1] >= 0, ids[has + 1], end + 1)
            key, inverse = np.unique(key, return_inverse=True)
            pos, rel, lp, bow = level.find(key // symbols, key % symbols)
            pair, number = np.full(len(ids), -1, np.int64), np.full(len(ids), -1, np.int64)
            pair[has + 1], number[has + 1] = pos[inverse], rel[inverse]
            score = np.zeros(len(ids))
            score[has + 1] = np.where(pos >= 0, lp, bow)[inverse]
            single = np.flatnonzero(pair < 0)                    # these need their unigram probability
            each, back = np.unique(ids[single], return_inverse=True)
            score[single] += vocabulary.log_probability(vocabulary.counts(each))[back]
            previous = np.concatenate([[-1], pair[:-1]])        # a text ends with its end, which has no successor
            open_ = (previous >= 0) & (pair >= 0)
            lone = (previous >= 0) & (pair < 0)
            code = np.rint(score / -level.step).astype(np.int64)
            edges = np.concatenate([[0], np.cumsum([r[2] for r in held])])
            fixed = np.where(open_, 0.0, score)
            rows = []
            for r, a, b in zip(held, edges[:-1], edges[1:]):
                o, x = open_[a:b], lone[a:b]
                rows.append((*r[:5], float(fixed[a:b].sum()), previous[a:b][o].astype("<i4").tobytes(),
                             number[a:b][o].astype("<i4").tobytes(), code[a:b][o].astype(np.uint8).tobytes(),
                             previous[a:b][x].astype("<i4").tobytes()))
            yield _frame(rows, [*columns[:5], "fixed", "pair", "rel", "code", "lone"])

    return table.mapInPandas(work, "doc_id long, train boolean, n_tokens long, n_known long, base_score double, "
                                   "fixed double, pair binary, rel binary, code binary, lone binary")


def with_triples(table: DataFrame, step2: float, level: Level, rule: TrieRule) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, base_score, score."""
    symbols = level.symbols

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["pair", "rel", "code", "lone", "doc_id", "train", "n_tokens", "n_known", "base_score", "fixed"]
        for held in _chunks(batches, columns, lambda r: r[6], rule.chunk_tokens):
            pair, rel, code = _joined(held)
            key, inverse = np.unique(pair * symbols + rel, return_inverse=True)
            pos, _, lp, bow = level.find(key // symbols, key % symbols)
            value = np.where(pos[inverse] >= 0, lp[inverse], bow[inverse] - step2 * code)
            lone = np.frombuffer(b"".join(r[3] for r in held), "<i4").astype(np.int64)
            each, back = np.unique(lone, return_inverse=True)
            weight = level.back_off(each)[back]
            a = np.concatenate([[0], np.cumsum([len(r[2]) for r in held])])
            b = np.concatenate([[0], np.cumsum([len(r[3]) // 4 for r in held])])
            rows = [(r[4], not r[5], *r[6:9],
                     r[9] + float(value[a[i]:a[i + 1]].sum()) + float(weight[b[i]:b[i + 1]].sum())) for i, r in enumerate(held)]
            yield _frame(rows, ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return table.mapInPandas(work, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, "
                                   "score double")


def _stored(df: DataFrame, name: str) -> DataFrame:
    """A stage table; the packed columns are worth a stronger codec."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stage_path = path
    return out


def train_and_score(docs: DataFrame, rule: TrieRule = TrieRule()) -> DataFrame:
    """Learn from the documents that are not held out (the crc32 of the id as text, modulo 7, is 2) and score all (doc_id,
    text): doc_id, held_out, n_tokens (words and one end), n_known (with a training count),
    train_tokens, base_score (add-one unigrams) and score, both log10 of the whole text.

    Null texts are empty; documents with a null id are held out; repeated rows count and are scored each; without training
    documents every token has probability 1; an empty table gives an empty result; other columns are ignored.
    The shared folder must be mounted on all executors for memory maps; else level files are read whole.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "trie")
    blobfile.make_folder(folder)
    remainder = F.crc32(F.col("doc_id").cast("long").cast("string")) % 7
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                       F.coalesce(remainder != 2, F.lit(False)).alias("train"))
    with shuffles_deleted(spark):
        model, table = train(rows, folder, rule)
    out = with_triples(table, model.level2.step, model.level3, rule)
    return out.withColumn("train_tokens", F.lit(model.vocabulary.tokens).cast("long"))


def train(rows: DataFrame, folder: str, rule: TrieRule) -> tuple[Model, DataFrame]:
    """The model of the rows with ``train`` and the table of all rows, scored with pairs."""
    vocabulary = build_vocabulary(rows, folder, rule)
    numbers = _stored(encode(rows, vocabulary, rule), "numbers")
    step = float(np.log10(2.0 * max(vocabulary.tokens, 5))) / 255
    symbols = vocabulary.words + 2                       # words, the end, and one that never occurs
    bounds = mass_bounds(vocabulary.at_mass, vocabulary.word_tokens, symbols,
                         lambda share, _: vocabulary.at_mass(share * vocabulary.word_tokens)[0], rule)
    level2, d2, most = build_level(
        pair_runs(numbers, vocabulary, symbols, bounds, rule), folder, symbols, rule.least[0], step, vocabulary.counts,
        lambda ids: vocabulary.log_probability(vocabulary.counts(ids)), 0.0)
    table = _stored(with_pairs(numbers, vocabulary, level2, rule), "pairs")
    discard(numbers)
    symbols = most + 1
    bounds = mass_bounds(level2.at_mass, level2.total, symbols, lambda share, _: int(share * most), rule)
    level3, d3, _ = build_level(triple_runs(table, symbols, bounds, rule), folder, symbols, rule.least[1], step,
                                level2.counts, None, step)
    return Model(vocabulary, level2, level3, [d2, d3]), table
