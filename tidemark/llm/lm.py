"""Operator 9, language-model scoring by context-tree weighting over bytes.

A text is lower-cased (A-Z), cut into words at ASCII white space and written as its words with one
space between them and one end byte. Every byte is eight binary decisions (its bits, high to low).
A decision node is a context of 0..DEPTH preceding bytes with the bits decided so far; each node has
the Krichevsky-Trofimov estimate of its two counts, and a node at depth d mixes it half and half with
the product of its children at depth d + 1. Given the training counts the mixture predicts bit by bit
along the path of contexts; contexts that training never met are left out of the path.

Counting is distributed: tasks count (DEPTH + 1)-grams of bytes, Spark sums them. No context is left out:
grams are dealt by their last CUT context bytes, so every task holds whole subtrees from depth CUT on, and
only the nodes above (at most 256 contexts) come to the driver. A gram's probability is that of its subtree
mixed with those nodes. The ``head_grams`` most frequent grams are looked up in place while texts are read,
all others are scored by the subtrees and joined.

The unigram base needs the count of every token: the ``head`` most frequent tokens (a bounded table)
are looked up in place, all others by a join on the token's hash.

Nulls: a null text is an empty text (its end token is scored); a null doc_id is kept, never held out and
trains. Repeated rows are scored each. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, remainder, stage, table, text_bytes

DEPTH = 5
END = 0x0A
#: Subtrees start at this depth; the tree above has at most 256 ** (CUT - 1) contexts.
CUT = 2
#: Grams that a task gathers before it builds the subtrees of the whole contexts among them.
CHUNK = 200_000
#: Bytes gathered before one count of distinct grams.
FLUSH = 6_000_000
#: Distinct grams that a task holds before it hands them over.
MOST_GRAMS = 2_000_000


def stream(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    """Gram codes of all texts in a row, the first gram of each text, and the words."""
    words = [t.lower().split() for t in texts]
    pad = bytes([END]) * depth
    pieces = [pad + b" ".join(w) + bytes([END]) for w in words]
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    raw = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    codes = raw.astype(np.uint64)
    for k in range(1, depth + 1):
        codes[k:] |= raw[:-k].astype(np.uint64) << np.uint64(8 * k)
    ends = np.cumsum(lengths)
    keep = np.ones(len(raw), dtype=bool)
    for k in range(depth):
        keep[(ends - lengths)[:] + k] = False
    sizes = lengths - depth
    return codes[keep], np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64) if len(texts) else np.zeros(0, np.int64), words


def context(codes: np.ndarray, depth: int) -> np.ndarray:
    """The code of the last ``depth`` context bytes and the symbol."""
    return codes & np.uint64((1 << (8 * (depth + 1))) - 1)


def nodes_of(codes: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Node keys (context and decided bits, with a leading one) of decision ``bit``, and the bit taken."""
    symbol = codes & np.uint64(255)
    prefix = (symbol >> np.uint64(8 - bit)) | np.uint64(1 << bit)
    return ((codes >> np.uint64(8)) << np.uint64(8)) | prefix, ((symbol >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


@dataclass
class Tree:
    """Per depth from ``first`` on: sorted node keys, the node's own estimate of a one, and the weight of that estimate.

    ``mixed`` is the natural logarithm of what the nodes of depth ``first`` mix to.
    """

    keys: list[np.ndarray]
    one: list[np.ndarray]
    own: list[np.ndarray]
    first: int
    mixed: np.ndarray

    def predict(self, codes: np.ndarray, above: Tree | None = None, chunk: int = 200_000) -> np.ndarray:
        """log10 of the probability of the symbol of each gram given its context; ``above`` is the tree over subtrees."""
        if len(codes) > chunk:
            return np.concatenate([self.predict(codes[i : i + chunk], above) for i in range(0, len(codes), chunk)])
        out = np.zeros(len(codes))
        for bit in range(8):
            p = np.full(len(codes), 0.5)
            fresh = np.ones(len(codes), dtype=bool)
            for tree in (self,) if above is None else (self, above):
                for d in range(len(tree.keys) - 1, -1, -1):
                    if not len(tree.keys[d]):
                        continue
                    key, taken = nodes_of(context(codes, tree.first + d), bit)
                    at = np.minimum(np.searchsorted(tree.keys[d], key), len(tree.keys[d]) - 1)
                    seen = tree.keys[d][at] == key
                    ones = tree.one[d][at]
                    own = np.where(taken == 1, ones, 1 - ones)
                    w = np.where(fresh, 1.0, tree.own[d][at])
                    p = np.where(seen, w * own + (1 - w) * p, p)
                    fresh &= ~seen
            out += np.log10(p)
        return out


def parents(keys: np.ndarray, depth: int) -> np.ndarray:
    """The nodes one byte shallower than nodes of ``depth``: the same symbol bits, the context without its oldest byte."""
    return (keys & np.uint64(255)) | (((keys >> np.uint64(8)) & np.uint64((1 << (8 * (depth - 1))) - 1)) << np.uint64(8))


def build_tree(grams: list[tuple[np.ndarray, np.ndarray]], first: int = 0, rest: tuple[np.ndarray, np.ndarray] | None = None) -> Tree:
    """``grams``: for each depth from ``first`` on the codes and counts of all contexts.

    Where the tree goes on below, ``rest`` has the sorted node keys of the deepest depth and what their children mix to.
    """
    from math import lgamma, pi

    small = np.array([lgamma(k + 0.5) for k in range(4096)])

    whole = np.array([lgamma(k + 1) for k in range(4096)])

    def log_gamma(n: np.ndarray, low: np.ndarray, plus: float) -> np.ndarray:
        """ln gamma(n + plus), by Stirling's series beyond the table."""
        out, far = low[np.minimum(n, 4095)], np.flatnonzero(n >= 4096)
        x = n[far] + plus
        out[far] = (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * pi) + 1 / (12 * x) - 1 / (360 * x**3)
        return out

    keys, zero, one = [], [], []
    for codes, counts in grams:
        k_all, z_all, o_all = [], [], []
        for bit in range(8):
            key, taken = nodes_of(codes, bit)
            unique, at = np.unique(key, return_inverse=True)
            k_all.append(unique)
            o_all.append(np.bincount(at, weights=counts * taken, minlength=len(unique)).astype(np.int64))
            z_all.append(np.bincount(at, weights=counts * (1 - taken), minlength=len(unique)).astype(np.int64))
        key = np.concatenate(k_all) if k_all else np.zeros(0, np.uint64)
        order = np.argsort(key)
        keys.append(key[order])
        zero.append(np.concatenate(z_all)[order])
        one.append(np.concatenate(o_all)[order])
    own: list[np.ndarray] = [np.zeros(0)] * len(grams)
    below = np.zeros(0)
    for d in range(len(grams) - 1, -1, -1):
        n0, n1 = zero[d], one[d]
        estimate = log_gamma(n0, small, 0.5) + log_gamma(n1, small, 0.5) - log_gamma(n0 + n1, whole, 1.0) - np.log(pi)
        if d == len(grams) - 1 and rest is None:
            below, own[d] = estimate, np.ones(len(n0))
            continue
        if d == len(grams) - 1:
            at, add = np.searchsorted(keys[d], rest[0]), rest[1]
        else:
            at, add = np.searchsorted(keys[d], parents(keys[d + 1], first + d + 1)), below
        below = np.logaddexp(estimate, np.bincount(at, weights=add, minlength=len(n0))) - np.log(2)
        own[d] = np.exp(np.clip(estimate - np.log(2) - below, -700, 0))
    ones = [(n1 + 0.5) / (n0 + n1 + 1) for n0, n1 in zip(zero, one, strict=True)]
    return Tree(keys, ones, own, first, below)


def subtrees(codes: np.ndarray, counts: np.ndarray, first: int, depth: int) -> Tree:
    """The trees from depth ``first`` on of the grams of whole contexts of that depth."""
    grams = []
    for d in range(first, depth + 1):
        unique, at = np.unique(context(codes, d), return_inverse=True)
        grams.append((unique, np.bincount(at, weights=counts, minlength=len(unique)).astype(np.int64)))
    return build_tree(grams, first)


class Seen:
    """An open-addressing table: gram code -> log10 probability."""

    def __init__(self, codes: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(10, int(np.ceil(np.log2(max(len(codes), 1) * 4))))
        self.codes = np.zeros(1 << self.bits, dtype=np.uint64)
        self.full = np.zeros(1 << self.bits, dtype=bool)
        self.values = np.zeros(1 << self.bits)
        left = np.arange(len(codes))
        slot = self._slot(codes)
        while len(left):
            free = ~self.full[slot[left]]
            first = np.unique(slot[left[free]], return_index=True)[1]
            put = left[free][first]
            self.codes[slot[put]], self.values[slot[put]], self.full[slot[put]] = codes[put], values[put], True
            left = np.setdiff1d(left, put, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and the places of codes that the table doesn't have."""
        slot = self._slot(codes)
        out = self.values[slot]
        left = np.flatnonzero((self.codes[slot] != codes) | ~self.full[slot])
        missing = []
        while len(left):
            at = slot[left]
            gone = ~self.full[at]
            missing.append(left[gone])
            left, at = left[~gone], at[~gone]
            hit = self.codes[at] == codes[left]
            out[left[hit]] = self.values[at[hit]]
            left = left[~hit]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
        return out, np.concatenate(missing) if missing else np.zeros(0, np.int64)


def log_probabilities(codes: np.ndarray, seen: Seen, tree: Tree) -> np.ndarray:
    values, missing = seen.get(codes)
    if len(missing):
        unique, at = np.unique(codes[missing], return_inverse=True)
        values[missing] = tree.predict(unique)[at]
    return values


def gram_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(code long, n long): counts of (depth + 1)-grams of bytes over all ``docs``."""

    def count(batches):
        waiting, size = [], 0
        codes, n = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged():
            new, times = np.unique(np.concatenate(waiting), return_counts=True)
            every, at = np.unique(np.concatenate([codes, new]), return_inverse=True)
            return every, np.bincount(at, weights=np.concatenate([n, times]), minlength=len(every)).astype(np.int64)

        def out():
            for i in range(0, len(codes), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(codes[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000])], names=["code", "n"])

        for batch in batches:
            own, _, _ = stream(text_bytes(batch), depth)
            waiting.append(own)
            size += len(own)
            if size > FLUSH:
                codes, n = merged()
                waiting, size = [], 0
                if len(codes) > MOST_GRAMS:
                    yield from out()
                    codes, n = codes[:0], n[:0]
        if size:
            codes, n = merged()
        yield from out()

    return map_batches(docs.select("text"), count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def token_counts(docs: DataFrame) -> DataFrame:
    """(word binary, n long): counts of tokens over all ``docs``, without the end tokens."""

    def count(batches):
        counts: Counter = Counter()

        def flush():
            pairs = list(counts.items())
            for i in range(0, len(pairs), 50_000):
                part = pairs[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in part], pa.binary()), pa.array([n for _, n in part], pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in text_bytes(batch):
                counts.update(text.lower().split())
            if len(counts) > 600_000:
                yield from flush()
                counts = Counter()
        yield from flush()

    return map_batches(docs.select("text"), count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def dealt(grams: DataFrame, cut: int) -> DataFrame:
    """Grams (code, n, asked) dealt and sorted by their last ``cut`` context bytes."""
    last = F.shiftrightunsigned("code", 8).bitwiseAND(F.lit((1 << (8 * cut)) - 1).cast("long"))
    return grams.select(last.alias("last"), "code", "n", "asked").repartition("last").sortWithinPartitions("last").select("code", "n", "asked")


def whole_contexts(batches, cut: int, least: int):
    """(codes, counts, asked) of dealt grams, ``least`` rows or more at a time, never parting a context of ``cut`` bytes."""
    waiting, size = [], 0

    def joined():
        return [np.concatenate(c) for c in zip(*waiting, strict=True)]

    for batch in batches:
        waiting.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)))
        size += batch.num_rows
        if size >= least:
            rows = joined()
            last = context(rows[0], cut) >> np.uint64(8)
            edge = int(np.flatnonzero(last == last[-1])[0])
            if edge:
                yield [c[:edge] for c in rows]
            waiting, size = [tuple(c[edge:] for c in rows)], 0
    if waiting:
        yield joined()


def tree_above(grams: DataFrame, depth: int, chunk: int) -> Tree:
    """The tree of the depths under CUT, with what the subtrees of ``grams`` (code, n) mix to."""
    cut = min(CUT, depth)
    if not cut:
        return Tree([], [], [], 0, np.zeros(0))

    def mix(batches):
        for codes, n, _ in whole_contexts(batches, cut, chunk):
            tree = subtrees(codes, n, cut, depth)
            keys, at = np.unique(parents(tree.keys[0], cut), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, weights=tree.mixed))], names=["key", "mixed"])

    sums = map_batches(dealt(grams.withColumn("asked", F.lit(False)), cut), mix, "key long, mixed double")
    rest = sums.groupBy("key").agg(F.sum("mixed").alias("mixed")).orderBy("key").toArrow()
    low = grams.groupBy(F.col("code").bitwiseAND(F.lit((1 << (8 * cut)) - 1).cast("long")).alias("code")).agg(F.sum("n").alias("n")).orderBy("code").toArrow()
    codes, n = low["code"].to_numpy().astype(np.int64).view(np.uint64), low["n"].to_numpy().astype(np.int64)
    upper = []
    for d in range(cut):
        unique, at = np.unique(context(codes, d), return_inverse=True)
        upper.append((unique, np.bincount(at, weights=n, minlength=len(unique)).astype(np.int64)))
    return build_tree(upper, 0, (rest["key"].to_numpy().astype(np.int64).view(np.uint64), rest["mixed"].to_numpy()))


def gram_logs(grams: DataFrame, above: Tree, depth: int, chunk: int) -> DataFrame:
    """(code long, log double): log10 of the probability of the grams asked for among ``grams`` (code, n, asked).

    Every gram of training stands there with its count, one that is asked for besides them with the count 0.
    """
    cut = min(CUT, depth)
    shared = grams.sparkSession.sparkContext.broadcast(above)

    def scan(batches):
        for codes, n, asked in whole_contexts(batches, cut, chunk):
            wanted = np.unique(codes[asked])
            if len(wanted):
                logs = subtrees(codes[n > 0], n[n > 0], cut, depth).predict(wanted, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(logs)], names=["code", "log"])

    return map_batches(dealt(grams, cut), scan, "code long, log double")


def least_count(grams: DataFrame, most: int) -> int:
    """A count that at most ``most`` grams reach, from the numbers of grams by eighths of a power of two."""
    level = F.floor(F.log2("n") * 8)
    least, total = 1 << 62, 0
    for row in grams.groupBy(level.alias("level")).agg(F.count("*").alias("k"), F.min("n").alias("least")).orderBy(F.desc("level")).collect():
        total += row["k"]
        if total > most:
            break
        least = row["least"]
    return least


def rare_grams(codes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[pa.ListArray, pa.ListArray]:
    """For each of ``n_rows`` texts its distinct ``codes`` and how often it has them; ``rows`` are the texts' places."""
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(len(codes), 1), bool), (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])]))
    offsets = pa.array(np.searchsorted(rows[new], np.arange(n_rows + 1)), pa.int32())
    return tuple(pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (codes[new].view(np.int64), np.diff(np.append(new, len(codes)))))


def score(docs: DataFrame, train: DataFrame, depth: int = DEPTH, head: int = 60_000, head_grams: int = 1_000_000, chunk: int = CHUNK) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text) by the model and by the unigram base learnt from ``train``.

    ``head``, ``head_grams`` and ``chunk`` bound what is held in memory and don't change the result.
    Returns doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes.
    """
    spark = docs.sparkSession
    counts = stage(token_counts(train), "tokens")
    total, kinds = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    ends = train.count()
    n_all, n_kinds = total + ends, kinds + (1 if ends else 0)
    top = counts.orderBy(F.desc("n"), "word").limit(head).toArrow()
    head_counts = top["n"].to_pylist()
    floor = min(head_counts, default=0)
    ranked = {word: log10(n + 1) for word, n in zip(top["word"].to_pylist(), head_counts, strict=True)}
    grams = stage(gram_counts(train, depth), "grams")
    above = tree_above(grams, depth, chunk)
    least = least_count(grams, head_grams)
    got = gram_logs(grams.withColumn("asked", F.col("n") >= least), above, depth, chunk).toArrow()
    known, values = got["code"].to_numpy().astype(np.int64).view(np.uint64), got["log"].to_numpy()
    shared = spark.sparkContext.broadcast((known, values, ranked, ends))

    def scan(batches):
        import xxhash

        known, values, ranked, ends = shared.value
        seen = Seen(known, values)
        digest, log_ends = xxhash.xxh64_intdigest, log10(ends + 1)
        for batch in batches:
            codes, starts, words = stream(text_bytes(batch), depth)
            logs, missing = seen.get(codes)
            logs[missing] = 0.0
            sums = np.add.reduceat(logs, starts) if len(starts) else np.zeros(0)
            sizes = np.diff(np.append(starts, len(codes)))
            grams, gram_times = rare_grams(codes[missing], np.searchsorted(starts, missing, "right") - 1, len(starts))
            n_tokens, n_known, head_sum, rare, times = [], [], [], [], []
            for w in words:
                found = list(map(ranked.get, w))
                lost = Counter(word for word, x in zip(w, found, strict=True) if x is None) if None in found else {}
                n_tokens.append(len(w) + 1)
                n_known.append(len(w) - sum(lost.values()) + (1 if ends else 0))
                head_sum.append(log_ends + (sum(x for x in found if x is not None) if lost else sum(found)))
                rare.append([digest(word) - (1 << 63) for word in lost])
                times.append(list(lost.values()))
            ids = batch.column(batch.schema.get_field_index("doc_id"))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(head_sum, pa.float64()), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int64())), pa.array(sums), pa.array(sizes, pa.int64()), grams, gram_times],
                names=["doc_id", "n_tokens", "n_known", "head_sum", "rare", "times", "score", "n_bytes", "grams", "gram_times"],
            )

    schema = "doc_id long, n_tokens long, n_known long, head_sum double, rare array<long>, times array<long>, score double, n_bytes long, grams array<long>, gram_times array<long>"
    first = map_batches(docs.select("doc_id", "text"), scan, schema)
    first = stage(first.withColumn("row", F.monotonically_increasing_id()), "scored")

    def hashed(batches):
        import xxhash

        for batch in batches:
            h = [xxhash.xxh64_intdigest(w) - (1 << 63) for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), batch.column(1)], names=["h", "c"])

    tail = counts.filter(F.col("n") <= floor).mapInArrow(hashed, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))
    far = first.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("h"), F.col("x.times").alias("tf"))
    found = far.join(tail, "h").groupBy("row").agg(F.sum("tf").alias("more"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("tail_sum"))
    open_grams = first.select("row", F.explode(F.arrays_zip("grams", "gram_times")).alias("x")).select("row", F.col("x.grams").alias("code"), F.col("x.gram_times").alias("tf"))
    asked = open_grams.select("code").distinct().select("code", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    logs = gram_logs(grams.withColumn("asked", F.lit(False)).unionByName(asked), above, depth, chunk)
    scored = open_grams.join(logs, "code").groupBy("row").agg(F.sum(F.col("tf") * F.col("log")).alias("gram_sum"))
    denominator = float(np.log10(n_all + n_kinds + 1))
    joined = first.drop("rare", "times", "grams", "gram_times").join(found, "row", "left").join(scored, "row", "left")
    return joined.select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.coalesce("tail_sum", F.lit(0.0)) - F.col("n_tokens") * F.lit(denominator)).alias("base_score"),
        (F.col("score") + F.coalesce("gram_sum", F.lit(0.0))).alias("score"),
        "n_bytes",
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, docs.filter(remainder(7) != 2))
    return scored.withColumn("held_out", remainder(7) == 2)
