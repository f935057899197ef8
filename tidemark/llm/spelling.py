"""Operator 12, spelling variant grouping by rolling-hash deletions.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. Then one of them is the
other without a code point, or both are the same without the code point of one place. So every word gets a key for itself
and one for each place left out. A key is a 64-bit polynomial hash that running prefix and suffix sums give for all places of
all words of a batch at once: prefix before the place + suffix behind it, shifted down by one power. Keys are
partitioned by their leading bits and sorted (a radix sort in Spark), so equal keys stand together; the strings of a
run of equal keys are compared, and what differs there is a collision and falls apart.

No pairs are made: what is left of a word is one group, which tells every member the number of near words in it and the
best of them. A word loses the same rest at one place only (of a stretch of equal letters the first counts), and
two words of one rest and place differ there and nowhere else, so every near word is counted once. Groups are bounded by the
alphabet times the length of a word. Words longer than ``LONG`` would carry themselves once a place; their keys carry
the word's hash instead, and strings are joined to the candidates.

Forms lead to words of at least twice the count, so following them ends; roots are found by doubling the steps.

Words are counted from the UTF-8 bytes: U+00C0 to U+00FF are the bytes C3 80 to C3 BF. Words of a batch are told apart by a hash, and each
occurrence is compared byte by byte with the first one of its hash.

Nulls: a null text has no words; a null doc_id is the empty string before the colon. Empty texts and tables give no words.
Repeated rows count each. Ties of n go to the smallest word in code-point order. Other columns are ignored by the
counts and kept by ``respelled``.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_batches, mix64, powers, stage, table, unstage

#: Longest word, in code points, whose keys carry the word itself.
LONG = 64
#: Different words that a task counts before it hands them on.
HELD = 200_000
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_PIECE = 1 << 18
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64))


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_CRC = _crc_table()


def runs(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with A-Z lower-cased, start, end, length in code points, row) of all maximal runs of letters of a string column."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = _LOWER[np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    lead = data == 0xC3
    inside = _LETTER[data] | lead
    inside[1:] |= lead[:-1]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    heads = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]  # a run ends with its text
    first[heads], last[heads - 1] = inside[heads], inside[heads - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    leads = np.flatnonzero(lead)
    points = end - start - (np.searchsorted(leads, end) - np.searchsorted(leads, start))
    return data, start, end, points, np.searchsorted(offsets, start, "right") - 1


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run, from running sums over pieces of the bytes."""
    out = np.empty(len(start), dtype=np.uint64)
    at = 0
    while at < len(start):
        stop = max(int(np.searchsorted(start, start[at] + _PIECE)), at + 1)
        a = int(start[at])
        part = data[a : int(end[stop - 1])]
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, dtype=np.uint64)
            np.cumsum(_VALUE[part] * powers(_BASE, len(part)), out=sums[1:])
            down = powers(_BACK, len(part))
            out[at:stop] = mix64((sums[end[at:stop] - a] - sums[start[at:stop] - a]) * down[start[at:stop] - a] + (end[at:stop] - start[at:stop]).astype(np.uint64))
        at = stop
    return out


def _walk(data: np.ndarray, start: np.ndarray, length: np.ndarray, like: np.ndarray, crc: np.ndarray | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Byte by byte through all runs at once: whether each equals the run of its length that starts at ``like``, and the crc32 carried on from ``crc``."""
    order = np.argsort(-length, kind="stable")
    here, there, sizes = start[order], like[order], length[order]
    same = np.ones(len(start), dtype=bool)
    state = None if crc is None else crc[order] ^ np.uint32(0xFFFFFFFF)
    for k in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -k))  # runs of more than k bytes
        byte = data[here[:m] + k]
        same[:m] &= byte == data[there[:m] + k]
        if state is not None:
            state[:m] = _CRC[(state[:m] ^ byte) & np.uint32(0xFF)] ^ (state[:m] >> np.uint32(8))
    equal = np.empty_like(same)
    equal[order] = same
    if state is None:
        return equal, None
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return equal, out


def _without(word: str, place: int) -> str:
    return word[:place] + word[place + 1 :]


def counted_batch(ids: list[str], column: pa.Array, least: int, thin: int | None) -> dict[bytes, int]:
    """Occurrences of the words of one batch of texts."""
    data, start, end, points, row = runs(column)
    keep = points >= least
    start, end, points, row = start[keep], end[keep], points[keep], row[keep]
    counts: dict[bytes, int] = defaultdict(int)
    if not len(start):
        return counts
    _, first, which = np.unique(run_hashes(data, start, end), return_index=True, return_inverse=True)
    like, length = start[first][which], end - start
    fits = length == length[first][which]
    crc = None if thin is None else np.array([zlib.crc32(f"{i}:".encode()) for i in ids], dtype=np.uint32)[row]
    same, crc = _walk(data, start, length, np.where(fits, like, start), crc)
    thinned = np.zeros(len(start), dtype=bool) if crc is None else crc % np.uint32(thin) == 0
    plain = fits & same & ~thinned
    flat = data.tobytes()
    for k in np.flatnonzero(thinned).tolist():
        word = _without(flat[start[k] : end[k]].decode(), int(crc[k]) % int(points[k]))
        if len(word) >= least:
            counts[word.encode()] += 1
    for k in np.flatnonzero(~plain & ~thinned).tolist():  # collisions of the hash
        counts[flat[start[k] : end[k]]] += 1
    for k, n in zip(first.tolist(), np.bincount(which[plain], minlength=len(first)).tolist(), strict=True):
        if n:
            counts[flat[start[k] : end[k]]] += n
    return counts


def word_counts(docs: DataFrame, least: int = 5, often: int = 3, thin: int | None = None) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) of at least ``least`` code points and ``often`` occurrences.

    With ``thin``, a run loses the code point crc32(doc_id:run) % length where ``thin`` divides the crc32.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = defaultdict(int)
        for batch in batches:
            for word, n in counted_batch(batch.column(0).to_pylist(), batch.column(1), least, thin).items():
                held[word] += n
            if len(held) >= HELD:
                yield _counts(held)
                held.clear()
        yield _counts(held)

    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    return map_batches(rows, scan, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)


def _counts(held: dict[bytes, int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()).cast(pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(own key of each word, key of each word without each place in a row, whether the place is the first of equal code points)."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    begin = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(begin, sizes)
    with np.errstate(over="ignore"):
        terms = mix64(flat.astype(np.uint64) + np.uint64(1)) * powers(_BASE, int(sizes.max(initial=1)))[place]
        sums = np.zeros(len(flat) + 1, dtype=np.uint64)
        np.cumsum(terms, out=sums[1:])
        total = sums[begin + sizes] - sums[begin]
        prefix = sums[:-1] - np.repeat(sums[begin], sizes)
        suffix = np.repeat(sums[begin + sizes], sizes) - sums[1:]
        without = mix64(prefix + suffix * np.uint64(_BACK) + (np.repeat(sizes, sizes) - 1).astype(np.uint64))
        own = mix64(total + sizes.astype(np.uint64))
    first = np.ones(len(flat), dtype=bool)
    first[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    return own, without, first


def keyed(words: DataFrame, carried: bool) -> DataFrame:
    """(key, place, first, own, word, n): a row for each word (place -1) and each place left out, dealt by leading bits and sorted by key.

    ``word`` is null unless ``carried``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            if not texts:
                continue
            own, without, first = deletion_keys(texts)
            sizes = np.array([len(t) for t in texts])
            each = np.concatenate([np.arange(len(texts)), np.repeat(np.arange(len(texts)), sizes)])
            places = np.concatenate([np.full(len(texts), -1), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, without]).view(np.int64)), pa.array(places.astype(np.int32)),
                    pa.array(np.concatenate([np.ones(len(texts), bool), first])), pa.array(own[each].view(np.int64)),
                    batch.column(0).take(pa.array(each)) if carried else pa.nulls(len(each), pa.string()), pa.array(n[each]),
                ],
                names=["key", "place", "first", "own", "word", "n"],
            )

    rows = map_batches(words.select("word", "n"), scan, "key long, place int, first boolean, own long, word string, n long")
    return rows.repartition(F.shiftrightunsigned("key", 48)).sortWithinPartitions("key")


def _told(words: list[str], places: list[int], firsts: list[bool], ns: list[int], out: list[tuple]) -> None:
    """Append (word, near words in this group, best n, best word) for the rows of one key."""
    rests: dict[str, list[int]] = defaultdict(list)
    for k, (w, p) in enumerate(zip(words, places, strict=True)):
        rests[w if p < 0 else _without(w, p)].append(k)
    for members in rests.values():
        if len(members) < 2:
            continue
        whole = [k for k in members if places[k] < 0]
        shorter = [k for k in members if places[k] >= 0 and firsts[k]]
        if whole and shorter:  # the rest is a word itself
            best = min((-ns[k], words[k]) for k in shorter)
            out.append((words[whole[0]], len(shorter), -best[0], best[1]))
            out += [(words[k], 1, ns[whole[0]], words[whole[0]]) for k in shorter]
        by_place: dict[int, list[int]] = defaultdict(list)
        for k in members:
            if places[k] >= 0:
                by_place[places[k]].append(k)
        for same in by_place.values():
            if len(same) > 1:
                ranked = sorted((-ns[k], words[k]) for k in same)
                for k in same:
                    n, w = ranked[0] if words[k] != ranked[0][1] else ranked[1]
                    out.append((words[k], len(same) - 1, -n, w))


def _near_short(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best): partial results of words of at most LONG code points with each other."""

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], t) for c, t in enumerate(types)], names=["word", "near", "best_n", "best"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = now if left is None else pa.concat_tables([left, now]).combine_chunks()
            keys = now.column("key").to_numpy()
            # the last key may go on in the next batch
            stop = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
            left = now.slice(stop)
            yield batch_of(groups_of(now.slice(0, stop), keys[:stop]))
        if left is not None:
            yield batch_of(groups_of(left, left.column("key").to_numpy()))

    def groups_of(rows: pa.Table, keys: np.ndarray) -> list[tuple]:
        out: list[tuple] = []
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]])) if len(keys) else np.zeros(1, int)
        many = np.flatnonzero(np.diff(edge) > 1)
        if not len(many):
            return out
        sizes = np.diff(edge)[many]
        picked = rows.take(pa.array(np.repeat(edge[many] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())))
        words, places, firsts, ns = (picked.column(c).to_pylist() for c in ("word", "place", "first", "n"))
        a = 0
        for size in sizes.tolist():
            _told(words[a : a + size], places[a : a + size], firsts[a : a + size], ns[a : a + size], out)
            a += size
        return out

    short = words.filter(F.char_length("word") <= LONG)
    return map_batches(keyed(short, True).select("key", "place", "first", "word", "n"), scan, "word string, near long, best_n long, best string")


def _near_long(words: DataFrame) -> DataFrame:
    """(word, near, best_n, best) for pairs of words of which one has more than LONG code points."""
    size = F.char_length("word")
    rows = keyed(words.filter(size >= LONG), False).select("key", "place", "first", "own")
    a, b = rows.alias("a"), rows.alias("b")
    inserted = (F.col("a.place") == -1) & (F.col("b.place") >= 0) & F.col("b.first")
    replaced = (F.col("a.place") == F.col("b.place")) & (F.col("a.own") < F.col("b.own")) & (F.col("a.place") >= 0)
    pairs = a.join(b, F.col("a.key") == F.col("b.key")).filter(inserted | replaced).select(F.col("a.own").alias("own_a"), F.col("b.own").alias("own_b"), F.col("b.place").alias("place"), F.col("a.place").alias("whole"))
    texts = keyed_words(words.filter(size >= LONG))
    named = pairs.join(texts.toDF("own_a", "word_a", "n_a"), "own_a").join(texts.toDF("own_b", "word_b", "n_b"), "own_b")
    rest = lambda c: F.concat(F.substr(c, F.lit(1), F.col("place")), F.substr(c, F.col("place") + 2))
    same = F.when(F.col("whole") == -1, F.col("word_a") == rest(F.col("word_b"))).otherwise(
        (F.col("word_a") != F.col("word_b")) & (rest(F.col("word_a")) == rest(F.col("word_b")))
    )
    far = F.greatest(F.char_length("word_a"), F.char_length("word_b")) > LONG
    links = named.filter(same & far).select(
        F.inline(F.array(
            F.struct(F.col("word_a").alias("word"), F.lit(1).cast("long").alias("near"), F.col("n_b").alias("best_n"), F.col("word_b").alias("best")),
            F.struct(F.col("word_b").alias("word"), F.lit(1).cast("long").alias("near"), F.col("n_a").alias("best_n"), F.col("word_a").alias("best")),
        ))
    )
    return links


def keyed_words(words: DataFrame) -> DataFrame:
    """(own, word, n): each word with its own key."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = deletion_keys(batch.column(0).to_pylist())[0] if batch.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column(0), batch.column(1)], names=["own", "word", "n"])

    return map_batches(words.select("word", "n"), scan, "own long, word string, n long")


def forms(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, n, n_near, form_n) of all ``words`` (word, n; distinct, a staged table): the near word of largest n where it has at least ``times`` the word's n."""
    parts = _near_short(words)
    if words.filter(F.char_length("word") > LONG).limit(1).count():
        parts = parts.unionByName(_near_long(words))
    near = parts.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best"))).alias("top"))
    joined = words.join(near, "word", "left")
    enough = -F.col("top.minus") >= times * F.col("n")
    return joined.select(
        "word", F.when(enough, F.col("top.best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, -F.col("top.minus")).alias("form_n"),
    )


def rooted(found: DataFrame, rounds: int = 64) -> DataFrame:
    """``found`` (word, form, ...; a staged table) with root: the end of the chain of forms, the word itself if it has none."""
    steps = stage(found.filter("form is not null").select("word", F.col("form").alias("to")), "steps")
    for _ in range(rounds):
        onward = steps.select(F.col("word").alias("to"), F.col("to").alias("next"))
        doubled = stage(steps.join(onward, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "steps")
        unstage(steps)
        steps = doubled.select("word", "to")
        if not doubled.filter("moved").limit(1).count():
            break
    return found.join(steps.withColumnRenamed("to", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def variants(docs: DataFrame, least: int = 5, often: int = 3, times: int = 2, thin: int | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words of ``docs``."""
    words = stage(word_counts(docs, least, often, thin), "words")
    return rooted(stage(forms(words, times), "forms")).select("word", "form", "root", "n", "n_near", "form_n")


def lowered(text: Column) -> Column:
    """``text`` with A-Z in lower case, other letters as they are."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def respelled(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, ...) with each word of the texts that has another root replaced by it, in lower case.

    Only the words that are respelled are joined: a row for each (text, word), brought together as a map for each text.
    """
    change = found.filter("root <> word").select(F.col("word").alias("w"), "root")
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("h"), F.col("text").alias("t"))
    words = packed.select("h", "t").dropDuplicates(["h", "t"]).select("h", "t", F.explode(F.array_distinct(F.regexp_extract_all(lowered(F.col("t")), F.lit(r"[a-zÀ-ÿ]+"), F.lit(0)))).alias("w"))
    maps = words.join(change, "w").groupBy("h", "t").agg(F.map_from_entries(F.collect_list(F.struct("w", "root"))).alias("m"))  # bounded by the text's own words
    pieces = lambda t: F.regexp_extract_all(t, F.lit(r"([A-Za-zÀ-ÿ]+)|([^A-Za-zÀ-ÿ]+)"), F.lit(0))
    new = F.array_join(F.transform(pieces(F.col("t")), lambda p: F.coalesce(F.try_element_at("m", lowered(p)), p)), "")
    joined = packed.join(maps, ["h", "t"], "left")
    return joined.select(*[(F.when(F.col("m").isNull(), F.col("t")).otherwise(new).alias(c) if c == "text" else F.col("row")[c].alias(c)) for c in docs.columns])


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), thin=97)
