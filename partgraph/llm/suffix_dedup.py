"""Suffix-array dedup: induced sorting of shards of suspect text (operator 9)."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partgraph.llm.common import _INVERSE, cut, documents, kept_while, mix, powers, skew_join, text_blocks, utf8_column, with_text

#: Bytes of a repeated string; bytes of the grams whose hashes choose a window's shard.
LENGTH, GRAM = 200, 64
#: Bytes of segments that a shard should hold, and beyond which a single gram's are split by their windows' content.
SHARD, HOT = 2 << 20, 8 << 20
#: Bytes of one text that are searched at once; the next piece begins with the windows that this one lacks.
PIECE = 1 << 20
#: Symbols up to which a bucket's entries are placed together; buckets of larger alphabets are too small for that.
SMALL_ALPHABET = 1024
#: Entries under which they are placed one by one.
FEW = 16

_BASE = 0x9E3779B97F4A7C15 | 1


# --- rolling hashes -----------------------------------------------------------


class Rolling:
    """Hashes of any substring of a block, from one running sum."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(31)) * powers(_BASE, n), out=self.sums[1:])
        self.inverse = powers(_INVERSE, n + 1)

    def at(self, start: np.ndarray, length) -> np.ndarray:
        return (self.sums[start + length] - self.sums[start]) * self.inverse[start]

    def every(self, length: int) -> np.ndarray:
        """Of the substrings of one length, at each place that has one."""
        return (self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.sums) - length]


def _sliding(best: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done * 2 <= width:
        x = best(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return best(x[:-rest], x[rest:]) if rest else x


def window_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(gram, row, start, windows, again): runs of the texts' windows of LENGTH bytes by their least gram hash.

    Equal windows have the same least gram, so they lie in runs of one gram,
    wherever they stand; a run of ``windows`` windows covers LENGTH - 1 more bytes.
    ``again`` is set where the gram stands twice within the run, as in text that
    repeats after a few bytes: then windows of one run may be equal.
    """
    if len(data) < LENGTH:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, bool))
    wide = LENGTH - GRAM + 1
    grams = mix(Rolling(data).every(GRAM))
    least = _sliding(np.minimum, grams, wide)
    place = np.arange(len(least))
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
    whole = np.flatnonzero(offsets[row + 1] - place >= LENGTH)
    value, owner = least[whole], row[whole]
    fresh = np.ones(len(whole), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(fresh)
    windows = np.diff(np.append(at, len(whole)))
    first, gram = whole[at], value[at]
    # Places of grams that are the least of some window, by (gram, place).
    pad = np.zeros(wide - 1, np.uint64)
    chosen = np.flatnonzero(grams == _sliding(np.maximum, np.concatenate([pad, least, pad]), wide))
    known, number = np.unique(grams[chosen], return_inverse=True)
    places = np.sort(number * np.int64(len(data)) + chosen)
    base = np.searchsorted(known, gram) * np.int64(len(data))
    last = np.minimum(first + windows + wide - 1, len(data))
    again = np.searchsorted(places, base + last) - np.searchsorted(places, base + first) > 1
    return gram.view(np.int64), owner[at], first - offsets[owner[at]], windows, again


def text_windows(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """``window_runs`` of a block of ``text_blocks``; a long text is searched in pieces, which may cut a run in two."""
    if len(offsets) != 2 or len(data) <= PIECE:
        yield window_runs(data, offsets)
        return
    for a in range(0, len(data) - LENGTH + 1, PIECE):
        piece = data[a : a + PIECE + LENGTH - 1]
        gram, row, start, windows, again = window_runs(piece, np.array([0, len(piece)]))
        yield gram, row, start + a, windows, again


# --- the suffix array -----------------------------------------------------------


def _buckets(t: np.ndarray, size: int) -> np.ndarray:
    return np.append(0, np.cumsum(np.bincount(t, minlength=size)))


def _induce(t: np.ndarray, small: np.ndarray, ordered: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in order, from leftmost-smaller ones in ``ordered``; linear.

    Every bucket is taken in order of its symbol; the suffixes that one wave of
    entries induces into a bucket are placed together, in the entries' order, a wave
    of few one by one (a run of one symbol induces one at a time).
    """
    if size > SMALL_ALPHABET:
        return _induce_singly(t, small, ordered, size)
    n, bounds = len(t), _buckets(t, size)
    sa = np.full(n, -1, np.int64)
    # Leftmost-smaller suffixes at the ends of their buckets.
    symbols = t[ordered]
    grouped = ordered[np.argsort(symbols, kind="stable")]
    counts = np.bincount(symbols, minlength=size)
    group_at = np.append(0, np.cumsum(counts))
    # Read one by one without numpy's cost for each.
    texts, kinds, out = memoryview(t), memoryview(small), memoryview(sa)

    def spread(entries: np.ndarray, place: np.ndarray, sign: int, kind: bool) -> None:
        if len(entries) < FEW:
            for e in entries.tolist():
                if e > 0 and kinds[e - 1] == kind:
                    ch = texts[e - 1]
                    out[place[ch]] = e - 1
                    place[ch] += sign
            return
        before = entries[entries > 0] - 1
        before = before[small[before] == kind]
        ch = t[before]
        order = np.argsort(ch, kind="stable")
        ch, before = ch[order], before[order]
        number = np.bincount(ch, minlength=size)
        first = np.cumsum(number) - number
        sa[place[ch] + sign * (np.arange(len(ch)) - first[ch])] = before
        place += sign * number

    head = bounds[:-1].copy()
    for c in range(size):
        if bounds[c] == bounds[c + 1]:
            continue
        lo = bounds[c]
        while lo < head[c]:
            entries, lo = sa[lo : head[c]], head[c]
            spread(entries, head, 1, False)
        spread(grouped[group_at[c] : group_at[c + 1]], head, 1, False)
    larger_end = head
    tail = bounds[1:] - 1
    for c in range(size - 1, -1, -1):
        if bounds[c] == bounds[c + 1]:
            continue
        hi = bounds[c + 1] - 1
        while hi > tail[c]:
            entries, hi = sa[tail[c] + 1 : hi + 1][::-1], tail[c]
            spread(entries, tail, -1, True)
        spread(sa[bounds[c] : larger_end[c]][::-1], tail, -1, True)
    sa[0] = n - 1  # the end follows nothing, so nothing induces it
    return sa


def _induce_singly(t: np.ndarray, small: np.ndarray, ordered: np.ndarray, size: int) -> np.ndarray:
    """``_induce`` for large alphabets: one entry after the other, over arrays of 4 bytes a suffix."""
    n, bounds = len(t), _buckets(t, size).astype(np.int32)
    text, kind = array("i", t.astype(np.int32).tobytes()), small.astype(np.uint8).tobytes()
    sa = array("i", [-1]) * n
    tail = array("i", (bounds[1:] - 1).tobytes())
    for e in reversed(ordered.tolist()):
        c = text[e]
        sa[tail[c]] = e
        tail[c] -= 1
    head = array("i", bounds[:-1].tobytes())
    # Both walks meet the entries that they place on the way.
    for e in sa:
        if e > 0 and not kind[e - 1]:
            c = text[e - 1]
            place = head[c]
            sa[place] = e - 1
            head[c] = place + 1
    tail = array("i", (bounds[1:] - 1).tobytes())
    for e in reversed(sa):
        if e > 0 and kind[e - 1]:
            c = text[e - 1]
            place = tail[c]
            sa[place] = e - 1
            tail[c] = place - 1
    sa[0] = n - 1
    return np.frombuffer(sa, np.int32).astype(np.int64)


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """The suffixes of ``t`` in order.

    ``t`` has symbols below ``size`` and ends with a 0 that stands nowhere else.
    Suffixes are smaller or larger than the next; the leftmost smaller ones cut the
    text into substrings, which are sorted by inducing, named, and sorted as a text
    of names by recursion, whatever the names' number; all other suffixes are
    induced from them.
    """
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    # The type of equal neighbours is that of the next different one; the end is smaller.
    known = np.append(step, 1)
    source = np.where(known != 0, np.arange(n), n)
    source = np.minimum.accumulate(source[::-1])[::-1]
    small = known[source] > 0
    small[-1] = True
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if len(leftmost) < 2:
        return _induce(t, small, leftmost, size)
    sa = _induce(t, small, leftmost, size)
    is_leftmost = np.zeros(n, bool)
    is_leftmost[leftmost] = True
    ordered = sa[is_leftmost[sa]]
    end = np.append(leftmost[1:], n - 1)
    index = np.zeros(n, np.int64)
    index[leftmost] = np.arange(len(leftmost))
    roll = Rolling(t)
    length = np.minimum(end - leftmost + 1, n - leftmost)
    content = mix(roll.at(leftmost, length) + length.astype(np.uint64))[index[ordered]]
    fresh = np.ones(len(ordered), bool)
    fresh[1:] = content[1:] != content[:-1]
    names = np.zeros(len(leftmost), np.int64)
    names[index[ordered]] = np.cumsum(fresh) - 1
    if fresh.all():
        return _induce(t, small, ordered, size)
    # The end's substring is the smallest and stands alone: its name is 0.
    inner = suffix_array(names, int(names.max()) + 1)
    return _induce(t, small, leftmost[inner], size)


def permuted_prefixes(roll: Rolling, sa: np.ndarray, most: int) -> np.ndarray:
    """In text order, for each suffix of ``sa`` its common prefix with the one before it there, up to ``most`` symbols.

    Found by halving steps over rolling hashes of 64 bits within the shard; -1 for
    the first suffix and for places that are not in ``sa``.
    """
    before = np.full(len(roll.sums), -1, np.int64)
    before[sa[1:]] = sa[:-1]
    a = np.flatnonzero(before >= 0)
    b = before[a]
    length = np.zeros(len(a), np.int64)
    step = 1 << (most.bit_length() - 1)
    while step:
        more = length + step
        ok = np.flatnonzero(more <= most)
        same = roll.at(a[ok], more[ok]) == roll.at(b[ok], more[ok])
        length[ok[same]] = more[ok[same]]
        step >>= 1
    before[a] = length
    return before


def repeated_windows(segments: list[bytes], first_key: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, start, end): runs of bytes of distinct segments under a window that stands elsewhere too.

    ``first_key`` tells apart the places of the segments' starts (a window's place
    is key + offset); ``many`` marks segments that stand at several places.
    """
    lengths = np.array([len(s) for s in segments])
    at = np.append(0, np.cumsum(lengths + 1))
    t = np.zeros(at[-1] + 1, np.uint16)
    t[:-1] = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    t[:-1] += 2
    t[at[1:] - 1] = 1
    sa = suffix_array(t, 258)
    owner = np.repeat(np.arange(len(segments)), lengths + 1)
    owner = np.append(owner, 0)
    left = at[1:][owner] - 1 - np.arange(len(t))
    left[-1] = 0
    sa = sa[left[sa] >= LENGTH]
    if not len(sa):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = permuted_prefixes(Rolling(t), sa, LENGTH)[sa] < LENGTH
    cluster = np.cumsum(fresh) - 1
    starts = np.flatnonzero(fresh)
    place = first_key[owner[sa]] + (sa - at[owner[sa]]).astype(np.uint64)
    differ = np.minimum.reduceat(place, starts) != np.maximum.reduceat(place, starts)
    differ |= np.logical_or.reduceat(many[owner[sa]], starts)
    hit = np.sort(sa[differ[cluster]])
    if not len(hit):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    fresh = np.ones(len(hit), bool)
    fresh[1:] = (hit[1:] > hit[:-1] + LENGTH) | (owner[hit[1:]] != owner[hit[:-1]])
    begin = np.flatnonzero(fresh)
    finish = np.append(begin[1:], len(hit)) - 1
    seg = owner[hit[begin]]
    return seg, hit[begin] - at[seg], hit[finish] + LENGTH - at[seg]


# --- the operator ---------------------------------------------------------------


def _suspects(docs: DataFrame) -> DataFrame:
    """(gram, t1, t2, start, windows, hot) of every window run whose gram stands in another run or twice in its own.

    The runs are written once and read for counts and rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                t1, t2 = (batch.column(i).slice(a, b - a).to_numpy() for i in (0, 1))
                for gram, row, start, windows, again in text_windows(data, offsets):
                    columns = [gram, t1[row], t2[row], start, windows, again]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["gram", "t1", "t2", "start", "windows", "again"])

    schema = "gram long, t1 long, t2 long, start long, windows long, again boolean"
    made = docs.select("t1", "t2", "text").mapInArrow(work, schema)
    with kept_while(made, "runs") as runs:
        return cut(_repeating(runs))


def _repeating(runs: DataFrame) -> DataFrame:
    """The runs whose gram stands in another run too, or twice in its own."""
    place = F.xxhash64("t1", "t2", "start")
    grams = runs.groupBy("gram").agg(
        F.min(place).alias("least"), F.max(place).alias("most"), F.max("again").alias("more"),
        F.sum(F.col("windows") + LENGTH).alias("bytes"),
    )
    grams = grams.where((F.col("least") != F.col("most")) | F.col("more")).select("gram", (F.col("bytes") > HOT).alias("hot"))
    return skew_join(runs.drop("again"), grams, ["gram"])


def repeated_spans(texts: DataFrame, suspects: DataFrame, chosen: DataFrame) -> DataFrame:
    """(t, spans): for each text the byte runs under repeated windows, unordered and overlapping.

    ``chosen`` (t1, t2, t, k) names the row k of ``texts`` (k, text) that stands for
    each text, and its number t. Window runs are cut out of those rows as segments and dealt to shards by their gram, so equal windows meet; a
    shard keeps distinct segments once and sorts their suffixes. Runs of a gram
    whose segments have more than HOT bytes are split by the hash of each window first, with
    counts aggregated before the shuffle, so that a shard holds grams of at most
    HOT bytes each, SHARD in all on the average.
    """
    per_text = suspects.groupBy("t1", "t2").agg(F.collect_set(F.struct("gram", "start", "windows", "hot")).alias("runs"))
    total = suspects.agg(F.sum(F.when(~F.col("hot"), F.col("windows") + LENGTH))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    with_runs = texts.join(per_text.join(chosen, ["t1", "t2"]), "k").select("t", "text", "runs")

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            lists = batch.column(2)
            fields = lists.flatten()
            gram, start, windows = (fields.field(i).to_numpy() for i in range(3))
            cold = ~fields.field(3).to_numpy(zero_copy_only=False)
            counts = np.diff(lists.offsets.to_numpy())
            row = np.repeat(np.arange(len(counts)), counts)[cold]
            gram, start, windows = gram[cold], start[cold], windows[cold]
            t = batch.column(0).to_numpy()[row]
            raw = data.tobytes()
            a = offsets[row] + start
            for i in range(0, len(a), 4096):
                s = slice(i, i + 4096)
                cut_out = [raw[x:y] for x, y in zip(a[s], a[s] + windows[s] + LENGTH - 1, strict=True)]
                shard = (mix(gram[s].view(np.uint64)) % np.uint64(shards)).astype(np.int64)
                columns = [pa.array(shard), pa.array(t[s]), pa.array(start[s]), pa.array(cut_out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "t", "start", "segment"])

    def sort(rows: pa.Table) -> pa.Table:
        t, start = rows["t"].to_numpy(), rows["start"].to_numpy()
        number: dict[bytes, int] = {}
        which = np.array([number.setdefault(s, len(number)) for s in rows["segment"].to_pylist()], np.int64)
        # The places of each distinct segment, once each.
        order = np.lexsort((start, t, which))
        which, t, start = which[order], t[order], start[order]
        fresh = np.ones(len(which), bool)
        fresh[1:] = (which[1:] != which[:-1]) | (t[1:] != t[:-1]) | (start[1:] != start[:-1])
        which, t, start = which[fresh], t[fresh], start[fresh]
        first = np.searchsorted(which, np.arange(len(number) + 1))
        key = mix(t.view(np.uint64)) + start.view(np.uint64)
        seg, a, b = repeated_windows(list(number), key[first[:-1]], np.diff(first) > 1)
        counts = first[seg + 1] - first[seg]
        total = int(counts.sum())
        at = np.arange(total) + np.repeat(first[seg] - (np.cumsum(counts) - counts), counts)
        a, b = np.repeat(a, counts) + start[at], np.repeat(b, counts) + start[at]
        return pa.table({"t": pa.array(t[at]), "a": pa.array(a), "b": pa.array(b)})

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h1", "h2", "t", "a"]
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            for i in range(batch.num_rows):
                runs = [r for r in batch.column(2)[i].as_py() if r["hot"]]
                if not runs:
                    continue
                body = data[offsets[i] : offsets[i + 1]]
                places = np.unique(np.concatenate([r["start"] + np.arange(r["windows"]) for r in runs]))
                one, two = Rolling(body).at(places, LENGTH), Rolling(body[::-1]).at(len(body) - places - LENGTH, LENGTH)
                columns = [mix(one).view(np.int64), mix(two).view(np.int64), np.full(len(places), batch.column(0)[i].as_py()), places]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    cold = with_runs.mapInArrow(segments, "shard long, t long, start long, segment binary")
    spans = cold.groupBy("shard").applyInArrow(sort, "t long, a long, b long")
    if not suspects.where("hot").isEmpty():
        heated = with_runs.where(F.exists("runs", lambda r: r["hot"])).mapInArrow(windows_of, "h1 long, h2 long, t long, a long")
        place = F.xxhash64("t", "a")
        again = heated.groupBy("h1", "h2").agg(F.min(place).alias("x"), F.max(place).alias("y")).where("x != y")
        same = skew_join(heated, again, ["h1", "h2"]).select("t", "a", (F.col("a") + LENGTH).alias("b"))
        spans = spans.unionByName(same)
    return spans.groupBy("t").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def _merged(spans: pa.Scalar) -> list[tuple[int, int]]:
    rows = spans.values
    a, b = rows.field(0).to_numpy(), rows.field(1).to_numpy()
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    fresh = np.append(True, a[1:] > b[:-1])
    at = np.flatnonzero(fresh)
    return list(zip(a[at].tolist(), b[np.append(at[1:], len(a)) - 1].tolist(), strict=True))


def dedup_bytes(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """Each text without the bytes of repeated LENGTH-byte strings.

    A byte goes where a LENGTH-byte string over it also starts at any other place
    of any text, the same one included, as the input stands; strings don't cross
    texts. Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and kept (the bytes left) if ``keep_text``.

    Texts that stand several times are known by two hashes (128 bits): they repeat
    whole, and one of each takes part in the search. Null and empty texts: no bytes.
    Texts under LENGTH bytes stay whole; long ones are searched in pieces. Repeated rows are copies of each other.
    Null doc_ids are ids like others. Extra columns are left out. No rows: no rows.
    """
    full = with_text(docs, "doc_id").withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})
    full = full.withColumn("k", F.struct("doc_id", "t1", "t2"))
    base = cut(
        full.select("k", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    )
    copies = base.groupBy("k.t1", "k.t2").agg(F.count(F.lit(1)).alias("copies"), F.min("k").alias("k"))
    copies = cut(copies.withColumn("t", F.monotonically_increasing_id()))
    suspects = _suspects(full)
    texts = full.select("k", "text")
    # Not cut: the texts are dealt by k once for the search and for the result.
    spans = repeated_spans(texts, suspects, copies.select("t1", "t2", "t", "k"))
    single = copies.where(F.col("copies") == 1).select("t", "k")
    extra = ", kept binary" if keep_text else ""

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k", "n_removed", "n_spans", "sha_kept"] + ["kept"] * keep_text
        for batch in batches:
            data, offsets = utf8_column(batch.column(1))
            gone, count, sums, rest = [], [], [], []
            for i, spans_of in enumerate(batch.column(2)):
                body, runs = data[offsets[i] : offsets[i + 1]].tobytes(), _merged(spans_of)
                at, parts = 0, []
                for a, b in runs:
                    parts.append(body[at:a])
                    at = b
                left = b"".join([*parts, body[at:]])
                gone.append(len(body) - len(left))
                count.append(len(runs))
                sums.append(hashlib.sha256(left).hexdigest())
                rest.append(left)
            columns = [batch.column(0), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sums, pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(rest, pa.binary())] * keep_text, names)

    runs_of = texts.join(single.join(spans, "t").select("k", "spans"), "k")
    changed = runs_of.mapInArrow(removed, "k struct<doc_id:long,t1:long,t2:long>, n_removed long, n_spans long, sha_kept string" + extra)
    # A row is the only one of its text if its key is a single's: copies of a text needn't meet to know it.
    known = single.select("k", F.lit(True).alias("single")).join(changed, "k", "left")
    out = base.join(known, "k", "left")
    whole = F.col("single").isNull() & (F.col("n_bytes") >= LENGTH)
    zero = F.lit(0).cast("long")
    columns = [
        "k.doc_id",
        "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(whole, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(whole, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
    ]
    if keep_text:
        columns.append(F.when(whole, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))
    return out.select(*columns)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all documents."""
    return dedup_bytes(documents(spark, sf_dir))
