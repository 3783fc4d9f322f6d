"""Same or near-same records across splits, by winnowed fingerprints.

Each text keeps the least rolling hash of every window of neighbouring word runs.  Windows grow with
the number of distinct runs, up to a bound; what a long window chooses a shorter one chooses too, so
texts of different length still agree on shared stretches.  Fingerprints are joined across the
splits; texts that meet and whose sketches agree are aligned (collinear seeds are chained, gaps
between them closed word by word), and the exact similarity of their sets of word runs decides.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwater.llm import meet
from headwater.llm import words as W
from headwater.llm.contained import contained_pairs
from headwater.llm.prefilter import bit_of, bitmap, bitmap_of, bits_for, only, without
from headwater.session import cut

#: Words of a seed of the alignment, and of a fingerprint: the runs that similarity counts.
GRAM, PRINT_GRAM = 6, 3
#: A text has a window of a sixteenth of its distinct runs, so about 32 fingerprints, up to this window.
WIDEST, PART = 64, 16
_TRAIN, _HELD = 0, 1
KINDS = ("raw", "example")


def window_of(n_runs: int, widest: int = WIDEST) -> int:
    """Of a text's distinct word runs, so that one that repeats itself keeps as many as what it repeats."""
    return max(1, min(widest, n_runs // PART))


def fingerprints(h: np.ndarray, gram: int = PRINT_GRAM, widest: int = WIDEST) -> np.ndarray:
    grams = W.ngram_hashes(h, gram)
    return np.unique(W.window_minima(grams, window_of(len(np.unique(grams)), widest)))


def _list_column(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.empty(0, np.int64)))


def lists_of(column: pa.ListArray) -> list[np.ndarray]:
    flat, off = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(column.offsets.to_numpy()))])
    return [flat[off[i] : off[i + 1]] for i in range(len(column))]


def _print_rows(k: int, least_words: int, widest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, n, runs, s1, s2, prints, sketch = [], [], [], [], [], [], []
            kinds = b.column(1).to_pylist()
            for i, text in enumerate(b.column(b.num_columns - 1)):
                h = W.word_hashes(text.as_py())
                if len(h) < max(least_words, k):
                    continue
                x, y = W.sequence_signature(h)
                grams = W.ngram_hashes(h, k)
                distinct = np.unique(grams)
                p = np.unique(W.window_minima(grams, window_of(len(distinct), widest))) ^ np.uint64(kinds[i])
                keep.append(i), n.append(len(h)), runs.append(len(distinct)), s1.append(x), s2.append(y), prints.append(p.view(np.int64))
                sketch.append(W.minwise(distinct, meet.VALUES))
            if keep:
                packed = meet.pack(np.concatenate(sketch) >> np.uint64(20), 16)
                sketches = _list_column(np.split(packed, len(keep)))
                taken = [c.take(pa.array(keep)) for c in b.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*taken, pa.array(n, pa.int32()), pa.array(runs, pa.int32()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), sketches, _list_column(prints)], [*b.schema.names[:-1], "n_words", "runs", "s1", "s2", "t16", "prints"]
                )

    return run


def _key_rows(held: np.ndarray, limit: int):
    """One row per fingerprint of a text, with what it is compared and refined by.  Of train texts only those
    that the bitmap of held-out ones doesn't rule out."""
    bits = int(len(held) * 64 - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, side, runs = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            sketches, prints = lists_of(b.column(3)), lists_of(b.column(4))
            sizes = np.array([len(p) for p in prints])
            if not sizes.sum():
                continue
            key, of = np.concatenate(prints), np.repeat(np.arange(len(prints)), sizes)
            values = np.stack(sketches).view("<u2").astype(np.uint64)  # a row per text
            bit = W.mix(key.view(np.uint64)) & np.uint64(bits)
            keep = (side[of] == _HELD) | ((held[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1)).astype(bool)
            key, of = key[keep], of[keep]
            yield meet.key_batch(key, of, ids, np.where(side == _TRAIN, -runs, runs), values, limit)

    return run


def _bit_rows(bits: int):
    """The bits of all fingerprints of a batch, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bit = np.unique(W.mix(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64)) & np.uint64((1 << bits) - 1))
            yield pa.RecordBatch.from_arrays([pa.array(bit.view(np.int64))], ["bit"])

    return run


def align(a: np.ndarray, b: np.ndarray, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a and of b the alignment covers.

    Seeds are word runs that stand once in each text; the longest collinear chain of them is kept and
    grown into the gaps from both ends, word by word.
    """
    in_a, in_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    ga, gb = W.ngram_hashes(a, gram), W.ngram_hashes(b, gram)
    if not len(ga) or not len(gb):
        return in_a, in_b
    va, ia, ca = np.unique(ga, return_index=True, return_counts=True)
    vb, ib, cb = np.unique(gb, return_index=True, return_counts=True)
    _, x, y = np.intersect1d(va[ca == 1], vb[cb == 1], assume_unique=True, return_indices=True)
    if not len(x):
        return in_a, in_b
    i, j = ia[ca == 1][x], ib[cb == 1][y]
    order = np.argsort(i)
    i, j = i[order], j[order]
    # Neighbouring seeds on a diagonal are one run.
    first = np.concatenate([[0], np.nonzero((np.diff(i) != 1) | (np.diff(j) != 1))[0] + 1])
    last = np.concatenate([first[1:] - 1, [len(i) - 1]])
    runs = [(int(i[f]), int(j[f]), int(i[e] - i[f]) + gram) for f, e in zip(first, last)]
    # Longest increasing chain of runs by their place in b.
    tails, tail_at, back = [], [], []
    for n, (_, at, _) in enumerate(runs):
        p = bisect_left(tails, at)
        tails[p : p + 1], tail_at[p : p + 1] = [at], [n]
        back.append(tail_at[p - 1] if p else -1)
    chain, n = [], tail_at[-1]
    while n >= 0:
        chain.append(runs[n])
        n = back[n]
    pa_, pb_ = 0, 0
    for ra, rb, length in [*reversed(chain), (len(a), len(b), 0)]:
        # Grow forward from the last run, then backward from this one.
        while pa_ < ra and pb_ < rb and a[pa_] == b[pb_]:
            in_a[pa_] = in_b[pb_] = True
            pa_, pb_ = pa_ + 1, pb_ + 1
        ea, eb = ra, rb
        while ea > pa_ and eb > pb_ and a[ea - 1] == b[eb - 1]:
            ea, eb = ea - 1, eb - 1
            in_a[ea] = in_b[eb] = True
        if ea - pa_ == eb - pb_ and ea > pa_:  # changed word for word
            same = a[pa_:ea] == b[pb_:eb]
            in_a[pa_:ea] |= same
            in_b[pb_:eb] |= same
        in_a[ra : ra + length] = in_b[rb : rb + length] = True
        pa_, pb_ = max(pa_, ra + length), max(pb_, rb + length)
    return in_a, in_b


def shared_runs(a: np.ndarray, b: np.ndarray, k: int) -> tuple[int, int, int]:
    """Distinct runs of a, of b, and of both."""
    x, y = np.unique(W.ngram_hashes(a, k)), np.unique(W.ngram_hashes(b, k))
    return len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))


def _sequence_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), _list_column([W.word_hashes(t.as_py()).view(np.int64) for t in b.column(1)])], ["node", "seq"])


def _bits(mask: np.ndarray) -> np.ndarray:
    packed = np.packbits(mask, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view(np.int64)


def _align_rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            train, held = ([x.view(np.uint64) for x in lists_of(b.column(c))] for c in (2, 3))
            sims, parts, covered, masks = [], [], [[], []], []
            for x, y in zip(train, held):
                in_x, in_y = align(x, y)
                n_x, n_y, both = shared_runs(x, y, k)
                sims.append(both / max(1, n_x + n_y - both)), parts.append(both / max(1, min(n_x, n_y)))
                covered[0].append(int(in_x.sum())), covered[1].append(int(in_y.sum())), masks.append(_bits(in_y))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(sims, pa.float64()), pa.array(parts, pa.float64()), pa.array(covered[0], pa.int32()), pa.array(covered[1], pa.int32()), _list_column(masks)],
                ["train_rep", "held_rep", "jaccard", "contained", "covered_train", "covered_held", "mask"],
            )

    return run


def side_of(split: Column) -> Column:
    s = F.trim(F.lower(split))
    return F.when(s == "train", _TRAIN).when(s.isin("validation", "test"), _HELD)


def cross_split(texts: DataFrame, *, k: int = 3, similarity: float = 0.5, contained: float | None = None, least_words: int = 30, widest: int = WIDEST, limit: int = 512, kinds: tuple[str, ...] = KINDS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of texts(kind, id, split, source, text).

    members(kind, id, node, side, split, source, n_words, rep): one row per text of at least
    least_words words with a split; node stands for kind and id, and rep is the least node of the same
    kind and side with the same words in the same order.  pairs(train_rep, held_rep, jaccard,
    contained, covered_train, covered_held, mask): representatives of either side that are aligned,
    with the similarity of their sets of k-word runs, the share of the shorter side's runs that both
    hold, the words that the alignment covers on either side and, bit by bit, those of the held-out
    one: all of at least ``similarity``, and some below it.  With ``contained``, also those of which
    the longer text holds at least that share of the shorter one's runs, by an exact search over all
    runs.  Ids are unique within a kind and less than 2 ** 62; kinds not listed count as none.  Null
    splits, null, empty and short texts are in neither; empty tables give empty results.
    """
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")) - 1
    rows = texts.where(F.col("kind").isin(*kinds) & F.col("id").isNotNull() & F.col("text").isNotNull()).select(
        (F.col("id").cast("long") * len(kinds) + number).alias("node"), number.cast("int").alias("kind_no"), side_of(F.col("split")).alias("side"), F.trim(F.lower("split")).alias("split"), "source", "text"
    ).where(F.col("side").isNotNull())
    prints = cut(rows.mapInArrow(W.freed(_print_rows(k, least_words, widest)), "node long, kind_no int, side int, split string, source string, n_words int, runs int, s1 long, s2 long, t16 array<long>, prints array<long>"))
    narrow = prints.select("node", "kind_no", "side", "split", "source", "n_words", "s1", "s2")
    reps = narrow.groupBy("kind_no", "side", "s1", "s2").agg(F.min("node").alias("rep"))
    members = narrow.join(reps, ["kind_no", "side", "s1", "s2"])
    members = cut(members.select(F.element_at(F.array(*map(F.lit, kinds)), F.col("kind_no") + 1).alias("kind"), F.expr(f"(node - kind_no) div {len(kinds)}").alias("id"), "node", "side", "split", "source", "n_words", "rep"))
    # Copies are taken out without moving the others: a text whose bit no copy has is none.
    copies = members.where("node != rep").select("node")
    copy_bits = bits_for(copies.count())
    is_copy = bitmap(copies, "node", bits=copy_bits)
    marked = prints.select("node", "side", "runs", "t16", "prints", bit_of("node", bits=copy_bits).alias("bit"))
    # Of the fingerprints of train texts only those move that a held-out text may hold, too.
    held = prints.where(F.col("side") == _HELD)
    bits = bits_for(held.agg(F.coalesce(F.sum(F.size("prints")), F.lit(0))).first()[0])
    key_rows = _key_rows(bitmap_of(held.select("prints").mapInArrow(_bit_rows(bits), "bit long"), bits), limit)
    # One function drops copies and makes keys, and the join has an exchange whatever its size: two functions in a stage would take two workers a task.
    some = marked.mapInArrow(only(is_copy), "node long, side int, runs int, t16 array<long>, prints array<long>").join(copies.hint("merge"), "node", "left_anti")
    keys = marked.mapInArrow(W.freed(without(is_copy, key_rows)), meet.SCHEMA).unionByName(some.mapInArrow(W.freed(key_rows), meet.SCHEMA))
    found = meet.met_pairs(keys, two_sided=True, similarity=similarity, limit=limit)
    if contained is not None:
        n_runs = prints.agg(F.coalesce(F.sum("runs"), F.lit(0))).first()[0]
        marked = rows.select("node", "kind_no", "side", bit_of("node", bits=copy_bits).alias("bit"), "text")
        found = found.unionByName(contained_pairs(marked, copies, is_copy, n_runs, contained, k=k, least_words=least_words)).distinct()
    found = cut(found.select(F.col("x").alias("train_rep"), F.col("y").alias("held_rep")))
    wanted = found.select(F.col("train_rep").alias("node")).union(found.select("held_rep")).distinct()
    bits = bits_for(2 * found.count())
    # Of the texts read again only those of a candidate pair leave their task, as word hashes.
    again = rows.select("node", "text", bit_of("node", bits=bits).alias("bit")).mapInArrow(W.freed(only(bitmap(wanted, "node", bits=bits), _sequence_rows)), "node long, seq array<long>")
    seqs = again.join(wanted, "node", "left_semi")
    both = found.join(seqs.select(F.col("node").alias("train_rep"), F.col("seq").alias("seq_train")), "train_rep").join(seqs.select(F.col("node").alias("held_rep"), F.col("seq").alias("seq_held")), "held_rep")
    pairs = both.select("train_rep", "held_rep", "seq_train", "seq_held").mapInArrow(W.freed(_align_rows(k)), "train_rep long, held_rep long, jaccard double, contained double, covered_train int, covered_held int, mask array<long>")
    return members, pairs


def _sides(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    return members.where(F.col("side") == _TRAIN).withColumnRenamed("rep", "train_rep"), members.where(F.col("side") == _HELD).withColumnRenamed("rep", "held_rep")


def close_pairs(members: DataFrame, pairs: DataFrame, similarity: float = 0.5) -> DataFrame:
    """(kind, id_a, id_b) of all records behind the pairs of at least that similarity, id_a < id_b."""
    train, held = _sides(members)
    near = pairs.where(F.col("jaccard") >= similarity).select("train_rep", "held_rep")
    x, y = train.select("train_rep", F.col("id").alias("x")), held.select("held_rep", "kind", F.col("id").alias("y"))
    return near.join(x, "train_rep").join(y, "held_rep").select("kind", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def overlaps(pairs: DataFrame, similarity: float, contained: float | None) -> DataFrame:
    """The pairs that are similar enough or of which one side is contained in the other."""
    by = F.col("jaccard") >= similarity
    return pairs.where(by if contained is None else by | (F.col("contained") >= contained))


def record_report(members: DataFrame, pairs: DataFrame, *, similarity: float = 0.5, contained: float | None = None) -> DataFrame:
    """One row per held-out record: kind, id, split, source, n_words, partners, jaccard, covered_words.

    partners: train records that overlap it, copies included.  jaccard: the greatest similarity, null
    without a partner.  covered_words: words that the alignment with any partner covers, each once.
    """
    train, held = _sides(members)
    near = overlaps(pairs, similarity, contained)
    copies = train.groupBy("train_rep").agg(F.count("*").alias("copies"))
    partners = near.select("train_rep", "held_rep", "jaccard").join(copies, "train_rep").groupBy("held_rep").agg(F.sum("copies").alias("partners"), F.max("jaccard").alias("jaccard"))
    # The union over partners: masks are or-ed word by word, map-side first.
    words = near.select("held_rep", F.posexplode("mask").alias("at", "word")).groupBy("held_rep", "at").agg(F.bit_or("word").alias("word"))
    covered = words.groupBy("held_rep").agg(F.sum(F.bit_count("word")).alias("covered"))
    out = held.join(partners, "held_rep", "left").join(covered, "held_rep", "left")
    return out.select("kind", "id", "split", "source", "n_words", F.coalesce("partners", F.lit(0)).cast("long").alias("partners"), "jaccard", F.coalesce("covered", F.lit(0)).cast("long").alias("covered_words"))


def coverage_report(records: DataFrame) -> DataFrame:
    """Of a record report, per kind, split and source: records, overlapping ones, words, and words covered by train texts."""
    return records.groupBy("kind", "split", "source").agg(
        F.count("*").alias("records"), F.sum((F.col("partners") > 0).cast("long")).alias("overlapping"), F.sum(F.col("n_words").cast("long")).alias("words"), F.sum("covered_words").alias("covered_words")
    )


def texts_of(records: DataFrame, examples: DataFrame) -> DataFrame:
    """(kind, id, split, source, text) of raw documents and of the user messages of training examples."""
    from headwater.llm.labels import canonical

    user = F.filter(F.coalesce("messages", F.array()), lambda m: F.lower(F.trim(m["role"])) == "user")
    raw = records.select(F.lit("raw").alias("kind"), F.col("record_id").alias("id"), "split", canonical(F.col("source")).alias("source"), F.col("content").alias("text"))
    return raw.unionByName(examples.select(F.lit("example").alias("kind"), F.col("example_id").alias("id"), "split", canonical(F.col("metadata.source")).alias("source"), F.array_join(F.transform(user, lambda m: F.coalesce(m["content"], F.lit(""))), "\n").alias("text")))
