"""Groups of similar documents: those whose SimHash balls meet, verified by the Jaccard similarity of
their shingle sets, then an exact join of the sets for what fingerprints miss.

The ball hashing of ``simhash`` (three words, two bits) puts all documents into components. Every document of a component
is compared with the first one, and those that are similar are joined before anything else is compared. Fingerprints that differ
by two bits are rare at similarity 0.8, so the rest is joined by the rarest shingles.

Two sets of similarity 0.8 share at least 0.8 of the larger one. Put in one order for all sets, the
first n - ceil(0.8 n) + 1 shingles of each must then have one in common, so every similar pair meets
at a shared shingle (prefix filter). The order puts rare shingles first, by exact counts: batches of documents send
their shingles to buckets of the hash range, where they are counted, and get back those that occur in two sets or more.
A shingle of one set only is sent once and never comes back; a document whose prefix consists of such shingles
has no partner and is done. The others keep the shingles that came back, which are all that they can share.

Only groups count, not pairs, so two documents that are joined already are not compared again. Where many meet
at a shingle, some members are compared with all others, sixteen times as many in every turn, and what they join is
joined before the next turn; when few pairs are still apart, all of them are compared. Before the exact
test a pair goes only if its sizes or the parities of its shingles prove a similarity below 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tracewright.llm.common import few_files, text_or_empty
from tracewright.llm.components import connected_components
from tracewright.llm.simhash import components, shingle_hashes
from tracewright.plans.tables import discard, materialize

PARITY = ["p0", "p1", "p2", "p3"]
BUCKET_SHINGLES = 1 << 20
BATCH_SHINGLES = 1 << 20
BATCH_DOCS = 60_000
_MAX_BUCKETS = 1 << 23
_LOW = np.uint64((1 << 40) - 1)
_IN_BATCH = 0xFFFF
_SENT = "bucket long, batch long, kind int, low binary, docs binary, counts binary"
_SETS = ("k long, doc_id long, n long, single long, p0 long, p1 long, p2 long, p3 long, "
         "keys array<long>, prefix array<long>")


@dataclass(frozen=True)
class Similar:
    """Five-word shingles, similarity 0.8. The others change the work, not the result: while more than ``apart``
    pairs for each member are apart, members are compared with the first ``block`` of their shingle, sixteen times as many each turn."""
    words: int = 5
    similarity: float = 0.8
    apart: int = 4
    block: int = 1


def _pack(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.int64)


def _split_batch(batch: int, rows: list[tuple], sets: list[np.ndarray], buckets: int) -> pd.DataFrame:
    """Rows that a batch of documents sends. To the buckets: shingles of one document of the batch with its number
    (kind 0) and shingles of several with their number of documents (kind 1). Past them: those documents (kind 2) and what
    the batch knows of its documents (kind 3)."""
    h = np.concatenate(sets)
    key = (((h >> np.uint64(40)) * np.uint64(buckets)) >> np.uint64(24) << np.uint64(40) | (h & _LOW)).astype(np.int64)
    doc = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    # a document counts once for two of its shingles with one key
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    key, doc = key[new], doc[new]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    held = np.diff(first, append=len(key))
    of_key = np.repeat(held, held)
    alone, many = of_key == 1, held > 1
    bucket = key >> 40
    out = []

    def send(kind: int, keys: np.ndarray, docs: np.ndarray | None, counts: np.ndarray | None) -> None:
        of = keys >> 40
        at = np.flatnonzero(np.diff(of, prepend=-1)).tolist()
        for a, b in zip(at, [*at[1:], len(keys)]):
            out.append((int(of[a]), batch, kind, _pack(keys[a:b] & int(_LOW)), None if docs is None else docs[a:b].astype("<u2").tobytes(),
                        None if counts is None else counts[a:b].astype("<u4").tobytes()))

    send(0, key[alone], doc[alone], None)
    send(1, key[first][many], None, held[many])
    spread = batch % buckets                    # any bucket passes these on
    out.append((spread, batch, 2, key[~alone].astype("<i8").tobytes(), doc[~alone].astype("<u2").tobytes(), None))
    ks, ids, ns = (np.array(x, "<i8") for x in zip(*rows))
    keys_of = np.bincount(doc, minlength=len(sets)).astype("<i8")
    out.append((spread, batch, 3, np.stack([ks, ids, ns, keys_of]).tobytes(), None, None))
    return pd.DataFrame(out, columns=["bucket", "batch", "kind", "low", "docs", "counts"])


def _sent(docs: DataFrame, rule: Similar, buckets: int) -> DataFrame:
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, sets, held, batch = [], [], 0, 0
        for frame in batches:
            for k, d, seq, text in zip(frame["k"].tolist(), frame["d"].tolist(), frame["seq"].tolist(), frame["text"]):
                h = np.unique(shingle_hashes(text, rule.words))
                if not len(h):
                    continue
                if not rows:
                    batch = seq
                rows.append((k, d, len(h)))
                sets.append(h)
                held += len(h)
                if held >= BATCH_SHINGLES or len(rows) >= BATCH_DOCS:
                    yield _split_batch(batch, rows, sets, buckets)
                    rows, sets, held = [], [], 0
        if rows:
            yield _split_batch(batch, rows, sets, buckets)

    return docs.mapInPandas(work, _SENT)


def _count(group: pd.DataFrame) -> pd.DataFrame:
    """One bucket: its shingles that occur in two sets or more go back to the batches with the logarithm of
    their counts (in eighths of a power of two); rows of kinds 2 and 3 pass."""
    passed = group[group["kind"] >= 2]
    sent = group[group["kind"] < 2]
    if not len(sent):
        return passed
    low = [_unpack(x) for x in sent["low"]]
    sizes = [len(x) for x in low]
    low = np.concatenate(low)
    docs = np.concatenate([np.frombuffer(d, "<u2") if kind == 0 else np.full(n, _IN_BATCH, np.uint16)
                           for kind, d, n in zip(sent["kind"], sent["docs"], sizes)])
    counts = np.concatenate([np.ones(n, np.int64) if kind == 0 else np.frombuffer(c, "<u4").astype(np.int64)
                             for kind, c, n in zip(sent["kind"], sent["counts"], sizes)])
    order = np.argsort(low, kind="stable")
    first = np.flatnonzero(np.diff(low[order], prepend=-1))
    total = np.add.reduceat(counts[order], first)
    of = np.empty(len(low), np.int64)
    of[order] = np.repeat(total, np.diff(first, append=len(low)))
    load = np.minimum(np.round(8 * np.log2(of)), 255).astype(np.uint8)
    ends = np.cumsum(sizes)
    out, bucket = [], int(group["bucket"].iloc[0])
    for batch, a, b in zip(sent["batch"].tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
        back = a + np.flatnonzero(of[a:b] > 1)
        if len(back):
            out.append((bucket, batch, 0, _pack(low[back]), docs[back].tobytes(), load[back].tobytes()))
    return pd.concat([passed, pd.DataFrame(out, columns=passed.columns)])


def _parity(keys: np.ndarray) -> np.ndarray:
    """256 bits as four signed words: bit i tells if the set holds an odd number of shingles of class i. Those of two
    sets differ in no more bits than the sets differ in shingles."""
    odd = np.bincount(keys & 255, minlength=256) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefixes(rule: Similar):
    """For one batch: the documents that may have a partner, with the shingles they may share and the rarest of them."""
    def work(group: pd.DataFrame) -> pd.DataFrame:
        about = group[group["kind"] == 3].iloc[0]
        ks, ids, ns, held = np.frombuffer(about["low"], "<i8").reshape(4, -1)
        within = group[group["kind"] == 2].iloc[0]
        own_key, own_doc = np.frombuffer(within["low"], "<i8"), np.frombuffer(within["docs"], "<u2").astype(np.int64)
        back = group[group["kind"] == 0]
        key = np.concatenate([np.zeros(0, np.int64), *[_unpack(x) + (b << 40) for x, b in zip(back["low"], back["bucket"].tolist())]])
        doc = np.concatenate([np.zeros(0, np.uint16), *[np.frombuffer(x, "<u2") for x in back["docs"]]]).astype(np.int64)
        load = np.concatenate([np.zeros(0, np.uint8), *[np.frombuffer(x, np.uint8) for x in back["counts"]]])
        common = doc == _IN_BATCH
        order = np.argsort(key[common])
        loads = load[common][order][np.searchsorted(key[common][order], own_key)] if len(own_key) else load[:0]
        key, doc = np.concatenate([key[~common], own_key]), np.concatenate([doc[~common], own_doc])
        load = np.concatenate([load[~common], loads])
        shared = np.bincount(doc, minlength=len(ks))
        single = held - shared
        wanted = ns - np.ceil(rule.similarity * ns - 1e-9).astype(np.int64) + 1 - single
        order = np.lexsort((key, load, doc))
        key, starts = key[order], np.concatenate([[0], np.cumsum(shared)])
        rows = []
        for i in np.flatnonzero((wanted > 0) & (shared > 0)).tolist():
            keys = key[starts[i]:starts[i + 1]]
            rows.append((ks[i], None if ids[i] == _NO_ID else ids[i], ns[i], ns[i] - shared[i], *_parity(keys).tolist(), np.sort(keys),
                         keys[:wanted[i]]))
        out = pd.DataFrame(rows, columns=["k", "doc_id", "n", "single", *PARITY, "keys", "prefix"])
        out["doc_id"] = out["doc_id"].astype("Int64")
        return out

    return work


_NO_ID = 2 ** 63 - 1


def partners(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """k, doc_id, n (shingles), single (those of no other document), p0..p3 (parities), keys (the other shingles) and prefix
    of the documents that may be similar to another one. ``docs`` has k, doc_id, text.

    Shingles are told apart by 40 bits of their hash beside those of the bucket. A doc_id of 2**63 - 1 counts as none.
    """
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = int(min(_MAX_BUCKETS, 1 + chars // (6 * BUCKET_SHINGLES)))          # about six characters a word
    rows = docs.select("k", F.coalesce("doc_id", F.lit(_NO_ID)).alias("d"), F.monotonically_increasing_id().alias("seq"), "text")
    counted = _sent(rows, rule, buckets).groupBy("bucket").applyInPandas(_count, _SENT)
    return counted.groupBy("batch").applyInPandas(_prefixes(rule), _SETS)


def _possible(a: str, b: str, rule: Similar) -> Column:
    """False only for pairs that cannot be similar: a set smaller than 0.8 of the other, or more
    differing parities and single shingles than similar sets of these sizes have differing shingles."""
    m, n = F.col(f"{a}.n"), F.col(f"{b}.n")
    parts = [F.bit_count(F.col(f"{a}.{w}").bitwiseXOR(F.col(f"{b}.{w}"))) for w in PARITY]
    differ = (1 - rule.similarity) / (1 + rule.similarity) * (m + n) + 1e-6
    return ((F.least(m, n) >= rule.similarity * F.greatest(m, n) - 1e-6)
            & (parts[0] + parts[1] + parts[2] + parts[3] + F.col(f"{a}.single") + F.col(f"{b}.single") <= differ))


def _verified(pairs: DataFrame, table: DataFrame, rule: Similar) -> DataFrame:
    """The pairs (a, b, other columns) whose shingle sets are similar."""
    left = table.select(F.col("k").alias("_a"), F.col("keys").alias("_x"), F.col("n").alias("_m"))
    right = table.select(F.col("k").alias("_b"), F.col("keys").alias("_y"), F.col("n").alias("_n"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    common = both.select(*pairs.columns, F.size(F.array_intersect("_x", "_y")).alias("_c"), "_m", "_n")
    near = F.col("_c") >= rule.similarity * (F.col("_m") + F.col("_n") - F.col("_c")) - 1e-9
    return few_files(common.filter(near).select(*pairs.columns).distinct())


def _meeting(table: DataFrame) -> DataFrame:
    """token, k, s (sizes and parities), c (k) of the prefix shingles that several keys have."""
    sent = table.select(F.explode("prefix").alias("token"), "k", F.struct("n", "single", *PARITY).alias("s")).distinct()
    shared = sent.groupBy("token").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("token").alias("_t"))
    return sent.join(shared, F.col("token") == F.col("_t")).select("token", "k", "s", F.col("k").alias("c"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """a, b: every document (k, text) with the first one of its component of SimHash balls."""
    found = components(docs.select(F.col("k").alias("doc_id"), "text"))
    pairs = found.filter(F.col("doc_id") != F.col("component_id"))
    return pairs.select(F.col("component_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def _grouped(members: DataFrame, links: DataFrame) -> DataFrame:
    """The members, ``c`` being the group that the links between groups (a, b) put them in. Members of one group are joined, and
    that is all that is asked of it: joined members that are still in two groups are compared once more."""
    group = connected_components(links, rounds=1).select(F.col("node").alias("_c"), "component")
    return materialize(few_files(members.join(group, F.col("c") == F.col("_c"), "left").select(
        "token", "k", "s", F.coalesce("component", "c").alias("c"))), "meeting")


def similar_links(docs: DataFrame, rule: Similar = Similar()) -> tuple[DataFrame, DataFrame]:
    """Table of the documents that may have a partner (k, doc_id, ...) and verified links (a, b) between them. Similar keys are
    joined by a path of links; those joined already need not have a link of their own."""
    table = materialize(partners(docs, rule), "similar-sets")
    checked = materialize(fingerprint_pairs(docs), "pairs")
    links = materialize(_verified(checked, table, rule), "verified")
    members = _grouped(_meeting(table), links)
    turn, block = 0, rule.block
    while True:
        # shingles whose members are all joined need no more work
        parts = members.groupBy("token", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))
        open_ = parts.groupBy("token").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("q"),
                                           F.count(F.lit(1)).alias("_p")).filter("_p > 1")
        open_ = materialize(few_files(open_.select(F.col("token").alias("_t"), "n", "q")), "open")
        rows, apart = open_.agg(F.sum("n"), F.sum((F.col("n") * F.col("n") - F.col("q")) / 2)).first()
        if not rows:
            break
        left = members.join(open_.select("_t"), F.col("token") == F.col("_t")).drop("_t")
        last = apart <= rule.apart * rows
        # members in a random order, the same one wherever they meet
        place = F.struct(F.xxhash64("k", F.lit(turn)), "k")
        x = left.select("token", F.col("k").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca"), place.alias("pa"))
        if last:
            others = left
        else:
            order = Window.partitionBy("token").orderBy(place)
            others = left.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= block).drop("_r")
            others = materialize(few_files(others), "compared")
        y = others.select(F.col("token").alias("_token"), F.col("k").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"),
                          place.alias("pb"))
        met = x.join(y, (F.col("token") == F.col("_token")) & (F.col("pa") > F.col("pb")) & (F.col("ca") != F.col("cb"))
                     & _possible("sa", "sb", rule))
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("ca", "cb").alias("ca"),
                         F.greatest("ca", "cb").alias("cb")).distinct()
        pairs = materialize(few_files(met.join(checked, ["a", "b"], "left_anti")), "pairs")
        found = materialize(_verified(pairs, table, rule), "verified")
        links = links.union(found.select("a", "b"))
        if last:
            discard(open_)
            break
        checked = checked.union(pairs.select("a", "b"))
        done = others.select(F.col("token").alias("_t"), F.col("k").alias("_d"))
        left = left.join(done, (F.col("token") == F.col("_t")) & (F.col("k") == F.col("_d")), "left_anti")
        after = _grouped(left, found.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        discard(open_, members, others)
        members, turn, block = after, turn + 1, 16 * block
    return table, links


def keep_one_of_similar(docs: DataFrame, rule: Similar = Similar()) -> DataFrame:
    """The documents that stay, with their columns: of each group of similar documents the one
    with the smallest doc_id (null ids last, then by a hash of the text).

    Documents without words are never grouped. Rows that repeat another one (same id and text) are
    reduced to one row. Empty tables and extra columns pass through.
    """
    rows = docs.select(F.struct("*").alias("_row")).select(
        "_row", F.xxhash64(F.col("_row.doc_id"), F.coalesce(F.col("_row.text"), F.lit(""))).alias("k"))
    keyed = docs.select(F.xxhash64("doc_id", text_or_empty()).alias("k"), F.col("doc_id").cast("long").alias("doc_id"),
                        F.col("text").alias("text"))
    table, links = similar_links(keyed, rule)
    found = connected_components(links)
    order = F.struct(F.coalesce("doc_id", F.lit(_NO_ID)).alias("o"), F.col("k").alias("k"))
    grouped = materialize(table.select("k", "doc_id").distinct().join(found, F.col("k") == F.col("node")), "groups")
    first = grouped.groupBy("component").agg(F.min(order).alias("_first"))
    lost = grouped.join(first, "component").filter(F.col("k") != F.col("_first.k")).select(F.col("k").alias("_k"))
    kept = rows.join(lost, F.col("k") == F.col("_k"), "left_anti")
    return kept.dropDuplicates(["k"]).select("_row.*")
