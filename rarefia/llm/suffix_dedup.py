"""Suffix-array dedup: every byte covered by a 200-byte string that starts anywhere else, too, is removed.

1. Every 200-byte window has an anchor, the 32-byte string in it with the least hash (the leftmost of equals). Equal
   windows have equal anchors at one distance, so windows need comparing only with those of equal anchors. Neighbouring
   windows share an anchor: a row (anchor, context) stands for about 85 of them.
2. Anchors that occur once end here. Contexts (all bytes of the windows of one anchor) that occur twice or more repeat as
   a whole.
3. Where an anchor has different contexts, those that share too few bytes with any other on either side of the anchor
   end here, too. The rest are dealt out by the anchor, and each shard builds the suffix array of
   its contexts by induced sorting: suffixes are classified, the leftmost-smaller ones' substrings are sorted, their
   names are sorted recursively, and the order of all others is induced in two linear passes. The permuted common
   prefixes then tell the windows that share 200 bytes with a neighbour in the array.
4. An anchor with more contexts than a shard should hold (a passage in a third of all documents) is split by the
   windows' own 128-bit hashes instead, which aggregate without ever meeting in one task.

Texts are known by their 128-bit hash, so copies share what is found and no table of texts is written.

Defined results: a null text is an empty one and loses nothing; so do texts under 200 bytes; rows that repeat remove each
other whole (from 200 bytes); matches never cross documents; very long texts are taken in blocks; extra columns are not
read; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_or_null, discard, ship, table, written
from .jaccard import mix

#: Bytes of a repeated string and of an anchor; windows in a block; bytes that one suffix array sorts, and that the contexts
#: of one anchor may have in a shard.
WINDOW, ANCHOR, BLOCK, SORTED, SHARD = 200, 32, 1 << 19, 1 << 19, 1 << 20
#: Left shares by which contexts that can't repeat are told.
SIDES = (24, 48, 72, 96, 120, 144)
_PLACE = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def _power(n: int) -> np.uint64:
    return np.uint64(pow(_BASE, n, 1 << 64))


def _twice(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of 2n bytes from those of n."""
    return h[:-n] * _power(n) + h[n:]


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(doc, lo, hi, anchor's place after lo, anchor, context) for the runs of windows lo to hi of the texts data[starts:ends] with one anchor."""
    n = len(data)
    if n < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    h = {1: _BYTES[data]}
    for k in (1, 2, 4, 8, 16, 32, 64):
        h[2 * k] = _twice(h[k], k)
    whole = h[128][: n - 199] * _power(72) + h[64][128 : n - 71] * _power(8) + h[8][192 : n - 7]
    gram = mix(h[ANCHOR])
    least = (gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64)
    k = 1
    while 2 * k <= WINDOW - ANCHOR + 1:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    rest = WINDOW - ANCHOR + 1 - k
    least = np.minimum(least[:-rest], least[rest:]) if rest else least
    at = (least & _PLACE).astype(np.int64)
    doc = np.searchsorted(starts, np.arange(n - WINDOW + 1), "right") - 1
    inside = np.flatnonzero(np.arange(n - WINDOW + 1) + WINDOW <= ends[doc])
    if not len(inside):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    new = np.flatnonzero((np.diff(inside) != 1) | (np.diff(at[inside]) != 0)) + 1
    lo, hi = inside[np.r_[0, new]], inside[np.r_[new - 1, len(inside) - 1]]
    q = at[lo]
    shape = ((hi - lo).astype(np.uint64) << np.uint64(32)) | (q - lo).astype(np.uint64)
    context = mix(mix(mix(whole[lo]) + whole[hi]) + shape)
    return doc[lo], lo - starts[doc[lo]], hi - starts[doc[lo]], q - lo, gram[q], context


_RUNS = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("lo", pa.int32()), ("span", pa.int32()), ("q", pa.int32()), ("g", pa.int64()), ("c", pa.int64())])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out(parts: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
        """parts: key, text, and the place of the text's first byte in its document."""
        size = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(size)
        doc, lo, hi, q, g, c = anchors(np.frombuffer(b"".join(p[2] for p in parts), np.uint8), ends - size, ends)
        base = np.array([p[3] for p in parts])
        keys = np.array([p[:2] for p in parts], np.int64).reshape(-1, 2)[doc]
        return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array((lo + base[doc]).astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array(q.astype(np.int32)), pa.array(g.view(np.int64)), pa.array(c.view(np.int64))], schema=_RUNS)

    held, size = [], 0
    for b in batches:
        for k1, k2, text in zip(*[b.column(c).to_pylist() for c in ("k1", "k2", "text")]):
            raw = text.encode()
            for at in range(0, max(len(raw) - WINDOW + 1, 0), BLOCK // 2):
                piece = raw[at : at + BLOCK // 2 + WINDOW - 1]
                if held and size + len(piece) > BLOCK:
                    yield out(held)
                    held, size = [], 0
                held.append((k1, k2, piece, at))
                size += len(piece)
    if held:
        yield out(held)


# --- induced sorting ---


def _groups(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A stable order of x, the values in it, where each value begins there, and how often it occurs."""
    order = np.argsort(x, kind="stable")
    first = np.flatnonzero(np.r_[True, x[order][1:] != x[order][:-1]])
    return order, x[order[first]], first, np.diff(np.r_[first, len(x)])


def suffix_array(s: np.ndarray, k: int, single: int = 1) -> np.ndarray:
    """The suffix array of s (numbers below k; its last is the only 0) by induced sorting.

    The numbers below ``single`` occur once each, and none after another. Suffixes are classified and buckets induced
    with numpy: all that one bucket induces at a time, which costs a few operations for each number there is. Where numbers
    are nearly as many as places, as in the recursion, ``induced_list`` goes from place to place instead.
    """
    s = np.asarray(s, np.int32)
    n = len(s)
    if k * 24 > n:
        return np.array(induced_list(s.tolist(), k), np.int64)
    differ = np.flatnonzero(s[:-1] != s[1:])
    after = differ[np.searchsorted(differ, np.arange(n - 1))]
    small = np.r_[s[after] < s[after + 1], True]  # the suffix is less than the next one
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    sizes = np.bincount(s, minlength=k)
    tails = np.cumsum(sizes)
    heads = tails - sizes
    larger = np.bincount(s[~small], minlength=k)  # of each number, the suffixes that are greater than their next
    begins = np.bincount(s[leftmost], minlength=k)
    present = [c for c in np.flatnonzero(sizes).tolist() if c >= single]

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        o, x, first, count = _groups(s[order])
        sa[np.repeat(tails[x] - count - first, count) + np.arange(len(order))] = order[o]
        head, tail = heads.copy(), tails.copy()

        def rightwards(found: np.ndarray) -> None:
            p = found[found > 0] - 1
            p = p[~small[p]]
            if len(p):
                o, x, first, count = _groups(s[p])
                sa[np.repeat(head[x] - first, count) + np.arange(len(p))] = p[o]
                head[x] += count

        def leftwards(found: np.ndarray) -> None:
            p = found[found > 0] - 1
            p = p[small[p]]
            if len(p):
                o, x, first, count = _groups(s[p])
                sa[np.repeat(tail[x] - 1 + first, count) - np.arange(len(p))] = p[o]
                tail[x] -= count

        rightwards(sa[: tails[single - 1]])
        for c in present:
            at = heads[c]
            while at < head[c]:  # a bucket adds to itself as long as its number repeats
                at, part = head[c], sa[at : head[c]]
                rightwards(part)
            rightwards(sa[tails[c] - begins[c] : tails[c]])
        for c in reversed(present):
            at = tails[c]
            while at > tail[c]:
                at, part = tail[c], sa[tail[c] : at][::-1]
                leftwards(part)
            leftwards(sa[heads[c] : heads[c] + larger[c]][::-1])
        return sa

    # names of the substrings from one leftmost-smaller suffix to the next, in their order
    end = np.zeros(n, np.int64)
    end[leftmost] = np.r_[leftmost[1:], n - 1]
    sa = induce(leftmost)
    sub = sa[end[sa] > 0] if len(leftmost) else sa[:0]
    long = end[sub] - sub
    alike = np.flatnonzero(long[1:] == long[:-1]) + 1
    reach = long[alike] + 1
    step = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    unlike = s[np.repeat(sub[alike], reach) + step] != s[np.repeat(sub[alike - 1], reach) + step]
    same = np.zeros(len(sub), bool)
    same[alike] = np.bincount(np.repeat(np.arange(len(alike)), reach), weights=unlike, minlength=len(alike)) == 0
    name = np.zeros(n, np.int64)
    name[sub] = np.cumsum(~same) - 1
    names = int(name[sub[-1]]) + 1 if len(sub) else 0
    order = leftmost[suffix_array(name[leftmost], names)] if names < len(leftmost) else sub
    return induce(order)


def induced_list(s: list[int], k: int) -> list[int]:
    """The same, place by place."""
    n = len(s)
    small = bytearray(n)
    small[n - 1] = 1
    for i in range(n - 2, -1, -1):
        if s[i] < s[i + 1] or (s[i] == s[i + 1] and small[i + 1]):
            small[i] = 1
    leftmost = [i for i in range(1, n) if small[i] and not small[i - 1]]
    sizes = [0] * k
    for x in s:
        sizes[x] += 1
    heads, tails, total = [0] * k, [0] * k, 0
    for x in range(k):
        heads[x] = total
        total += sizes[x]
        tails[x] = total

    def induce(order: list[int]) -> list[int]:
        sa = [-1] * n
        tail = tails[:]
        for i in reversed(order):
            x = s[i]
            tail[x] -= 1
            sa[tail[x]] = i
        head = heads[:]
        for j in range(n):
            i = sa[j] - 1
            if i >= 0 and not small[i]:
                x = s[i]
                sa[head[x]] = i
                head[x] += 1
        tail = tails[:]
        for j in range(n - 1, -1, -1):
            i = sa[j] - 1
            if i >= 0 and small[i]:
                x = s[i]
                tail[x] -= 1
                sa[tail[x]] = i
        return sa

    sa = induce(leftmost)
    end = {i: j for i, j in zip(leftmost, leftmost[1:] + [n - 1])}
    name, names, last = -1, {}, None
    for i in sa:
        if i in end:
            sub = s[i : end[i] + 1]
            if sub != last:
                name, last = name + 1, sub
            names[i] = name
    if name + 1 < len(leftmost):
        order = [leftmost[i] for i in induced_list([names[i] for i in leftmost], name + 1)]
    else:
        order = sorted(leftmost, key=names.__getitem__)
    return induce(order)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(before, plcp): by position, the suffix before it in the array (-1: none) and the length of their common prefix.

    Where the letters before both are equal, the length is one less than at the position before; only the others are
    compared, letter by letter and all at once.
    """
    s = np.asarray(s)
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    back = np.maximum(before - 1, 0)
    least = (before <= 0) | (s[np.maximum(np.arange(n) - 1, 0)] != s[back])
    least[0] = True
    plcp = np.zeros(n, np.int64)
    live = np.flatnonzero(least & (before >= 0))
    length = 0
    while len(live):
        live = live[np.maximum(live, before[live]) + length < n]
        live = live[s[live + length] == s[before[live] + length]]
        length += 1
        plcp[live] = length
    source = np.maximum.accumulate(np.where(least, np.arange(n), 0))
    return before, np.maximum(plcp[source] - (np.arange(n) - source), 0)


def repeated_starts(contexts: list[bytes]) -> list[np.ndarray]:
    """For each context the starts of its windows that occur elsewhere in the contexts. Equal contexts repeat as a whole, and one of
    them is sorted."""
    times: dict[bytes, int] = {}
    for c in contexts:
        times[c] = times.get(c, 0) + 1
    m, size = len(times), np.fromiter(map(len, times), np.int64, len(times))
    starts = np.cumsum(size + 1) - size - 1
    # each context ends with a separator of its own, so no common prefix goes beyond it; 0 ends all
    s = np.zeros(int(size.sum()) + m + 1, np.int32)
    inside = np.ones(len(s), bool)
    inside[starts + size] = inside[-1] = False
    s[inside] = np.frombuffer(b"".join(times), np.uint8).astype(np.int32) + m + 1
    s[starts + size] = np.arange(m, 0, -1)
    before, plcp = common_prefixes(s, suffix_array(s, m + 257, m + 1))
    found = np.zeros(len(s), bool)
    hits = np.flatnonzero(plcp >= WINDOW)
    found[hits] = True
    found[before[hits]] = True
    own = {c: np.arange(len(c) - WINDOW + 1) if times[c] > 1 else np.flatnonzero(found[a : a + len(c)]) for a, c in zip(starts.tolist(), times)}
    return [own[c] for c in contexts]


def spans(starts: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs (first, last) of ascending numbers."""
    if not len(starts):
        return []
    new = np.flatnonzero(np.diff(starts) != 1) + 1
    return list(zip(starts[np.r_[0, new]].tolist(), starts[np.r_[new - 1, len(starts) - 1]].tolist()))


def _sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts, those of one anchor together: as many anchors at a time as a suffix array should sort."""

    def out(rows: list[tuple]) -> pa.RecordBatch:
        got = [(r[1], r[2], r[3] + a, r[3] + b + WINDOW) for r, f in zip(rows, repeated_starts([r[4] for r in rows])) for a, b in spans(f)]
        return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "a", "b"])

    held, size, now = [], 0, None
    for b in batches:
        for row in zip(*[b.column(c).to_pylist() for c in ("g", "k1", "k2", "lo", "context")]):
            if held and row[0] != now and size >= SORTED:
                yield out(held)
                held, size = [], 0
            now = row[0]
            held.append(row)
            size += len(row[4])
    if held:
        yield out(held)


# --- the operator ---


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, k1, k2)."""
    d = columns_or_null(docs, doc_id="long", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    return d.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), "text")})


def shared_sides(cut: DataFrame) -> DataFrame:
    """The contexts that may share a window with another context of their anchor, trimmed to the bytes that such windows have.

    Two windows that are equal share their bytes on both sides of the anchor, ``WINDOW - ANCHOR`` in sum; so for any a, the
    contexts share a bytes on the left or the rest on the right. A context that shares neither with any other, for
    one of the values of ``SIDES``, has no repeated window; and none reaches beyond what is shared on a side.
    """
    rest = WINDOW - ANCHOR
    left = lambda a: F.when(F.col("q") >= a, F.xxhash64(F.lit(a), F.substring(F.col("context"), F.col("q") - a + 1, F.lit(a))))
    right = lambda b: F.when(F.col("span") + WINDOW >= F.col("q") + ANCHOR + b, F.xxhash64(F.lit(-b), F.substring(F.col("context"), F.col("q") + ANCHOR + 1, F.lit(b))))
    pairs = [(j, a, rest + 1 - a) for j, a in enumerate(SIDES)]
    sides = [F.struct(F.lit(j).alias("j"), F.lit(m).alias("m"), h.alias("h")) for j, a, b in pairs for m, h in ((a, left(a)), (-b, right(b)))]
    keys = cut.select("g", "c", F.inline(F.array(*sides))).where("h is not null")
    often = written(keys.groupBy("g", "h").agg(F.count("*").alias("n")).where("n > 1").select("g", "h"))
    alike = keys.join(often, ["g", "h"]).groupBy("g", "c").agg(F.count_distinct("j").alias("n"), F.greatest(F.max("m"), F.lit(0)).alias("l"), F.greatest(-F.min("m"), F.lit(0)).alias("r"))

    def below(shared, steps: list[int]):
        """What is shared is under the next of the steps."""
        bound = F.lit(rest)
        for step in sorted(steps, reverse=True):
            bound = F.when(shared < step, step - 1).otherwise(bound)
        return bound

    both = cut.join(alike.where(F.col("n") == len(SIDES)), ["g", "c"])
    first = F.greatest(F.col("q") - below(F.col("l"), [a for _, a, _ in pairs]), F.lit(0))
    end = F.least(F.col("span") + WINDOW, F.col("q") + ANCHOR + below(F.col("r"), [b for _, _, b in pairs]))
    both = both.withColumn("_f", first).withColumn("_n", end - F.col("_f")).where(F.col("_n") >= WINDOW)
    return both.select("g", "c", "k1", "k2", (F.col("lo") + F.col("_f")).alias("lo"), (F.col("_n") - WINDOW).alias("span"), F.substring(F.col("context"), F.col("_f") + 1, F.col("_n")).alias("context"))


def covered(docs: DataFrame) -> DataFrame:
    """(k1, k2, a, b): bytes a to b (exclusive) of the texts that repeated windows cover; they may overlap.

    What is counted by an anchor is written before it is joined with, so that Spark can split an anchor with very many rows.
    """
    runs = written(docs.where(F.octet_length("text") >= WINDOW).select("k1", "k2", "text").mapInArrow(_runs, "k1 long, k2 long, lo int, span int, q int, g long, c long"))
    contexts = written(runs.groupBy("g", "c").agg(F.count("*").alias("n"), *[F.first(x).alias(x) for x in ("k1", "k2", "lo", "span", "q")]))
    again = written(contexts.where("n > 1").select("g", "c"))
    whole = written(runs.join(again, ["g", "c"]).select("k1", "k2", F.col("lo").alias("a"), (F.col("lo") + F.col("span") + WINDOW).alias("b")).distinct())
    discard(runs, again)
    several = written(contexts.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1").select("g"))
    open_ = contexts.join(several, "g").select("g", "c", "k1", "k2", "lo", "span", "q")
    texts = docs.groupBy("k1", "k2").agg(F.first("text").alias("text"))
    texts_cut = written(open_.join(texts, ["k1", "k2"]).withColumn("context", F.substring(F.col("text").cast("binary"), F.col("lo") + 1, F.col("span") + WINDOW)).drop("text"))
    discard(contexts, several)
    cut = written(shared_sides(texts_cut))
    discard(texts_cut)
    size = written(cut.groupBy("g").agg(F.sum(F.col("span") + WINDOW).alias("bytes")))
    total = size.where(F.col("bytes") <= SHARD).agg(F.sum("bytes")).head()[0] or 0
    sized = cut.join(size, "g")
    # tasks by bytes of contexts, as sorting costs more than reading
    shards = sized.where(F.col("bytes") <= SHARD).select("g", "k1", "k2", "lo", "context").repartition(max(1, -(-total // SHARD)), "g").sortWithinPartitions("g")
    sorted_ = shards.mapInArrow(_sorted_shard, "k1 long, k2 long, a int, b int")
    # the windows of an anchor with too many contexts: their hashes take the anchor's place
    piece = lambda i: F.substring(F.col("context"), i + 1, F.lit(WINDOW))
    windows = F.transform(F.sequence(F.lit(0), F.col("span")), lambda i: F.struct(i.alias("i"), F.xxhash64(piece(i)).alias("w1"), F.xxhash64(F.lit(1), piece(i)).alias("w2")))
    large = written(sized.where(F.col("bytes") > SHARD).select("k1", "k2", "lo", F.inline(windows)))
    twice = written(large.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2"))
    hashed = large.join(twice, ["w1", "w2"]).select("k1", "k2", (F.col("lo") + F.col("i")).alias("a"), (F.col("lo") + F.col("i") + WINDOW).alias("b"))
    out = written(whole.union(sorted_).union(hashed))
    discard(whole, cut, size, large, twice)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans and ``kept``, the remaining bytes."""
    ship(docs.sparkSession)
    rows = keyed(docs)
    # by text, each stretch once; then they are as many as one text has
    gone = covered(rows)
    by_text = written(gone.distinct().groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("gone")))
    discard(gone)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 512):
                part = b.slice(k, 512)
                cols = [[], [], [], []]
                for text, gone in zip(part.column("text").to_pylist(), part.column("gone").to_pylist()):
                    raw = text.encode()
                    kept, at, n = [], 0, 0
                    for x in gone or []:
                        if x["a"] > at or not n:
                            kept.append(raw[at : x["a"]])
                            n += 1
                        at = max(at, x["b"])
                    kept.append(raw[at:])
                    left = b"".join(kept)
                    for c, v in zip(cols, (len(raw), len(raw) - len(left), n, left)):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *[pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = rows.join(by_text, ["k1", "k2"], "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8(spark, sf_dir: str) -> DataFrame:
    """The query: what is removed from every document."""
    out = remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
