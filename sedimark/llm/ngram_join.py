"""N-gram Jaccard self-join by a size-aware heavy-light scheme, and its connected components.

A document's set holds the hashes of its distinct k-word shingles. Two sets link
when ``den * intersection >= num * union``; with t = num / den, linked sets of
sizes a <= b have a >= t * b and differ in at most a * (1 - t) / t elements.

*Light sets* (size below the boundary) enumerate subsets: for each size b that a
partner may have, all subsets of the fixed size c that a link demands in common.
Linked light sets share one of these. *Heavy sets* post to inverted lists. A
single shingle as the list's key would put every holder of a common passage in
one list, so a key is a block: the hash range is cut into more blocks than linked
sets can differ in (by size class), each set posts the content of its blocks, and
by the pigeonhole principle linked sets share a block with the same content.
Blocks without an element don't count; ``slack`` further blocks make up for
these, and sets with more empty blocks than that also post the shingles of their
prefix, the usual inverted list. The *boundary* is the size from which
enumerating a set's subsets costs more rows than its postings.

Nothing here makes all pairs of a list. Copies count as one set from the start.
Round one verifies each set against the smallest set that it meets in any list,
and takes components; round two does the same inside the lists that still hold
several components, against each list's smallest member. Only pairs of different
components that share a list and have not been compared are left for round three,
which compares them all: no link between components is lost, and a link inside a
component changes nothing. Members of long lists meet there once more through
inverted lists of their rarest shingles, which the versions of a text that are no
longer alike don't share.

Defined cases: a null text, or one without words, has an empty set and is linked
with nothing, not even its like; a text of fewer than k words has its whole word
sequence as its one shingle; rows that share a doc_id are one document if their
sets agree, else each row gets the component of its own set; an empty table gives
no row; very long texts are shingled whole.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.llm.common import bucketed, lean, materialise, table

_M = np.uint64
ODD = _M(0x9E3779B97F4A7C15)
BYTE_VALUES = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=np.uint64) * _M(2) + _M(1)
#: Bits of the filter that tells workers which sets are to be compared: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
#: Bytes of text that are shingled at once.
BLOCK_BYTES = 1 << 21
#: Bytes whose words are hashed at once.
SLICE = 1 << 18
#: Lists of so many members at most are compared member by member in round three; longer ones by rare elements.
FEW = 8


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which all bits count."""
    x = (x ^ (x >> _M(30))) * _M(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _M(27))) * _M(0x94D049BB133111EB)
    return x ^ (x >> _M(31))


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, edges of each text's words): A-Z lower-cased, words cut at ASCII white space. Only SLICE bytes at a time, and the word that they end in, are held as arrays of numbers."""
    lowered = [(t or b"").lower() for t in texts]
    data = np.frombuffer(b"\n".join(lowered) + b"\n", np.uint8)
    starts, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
    while at < len(data):
        end = min(at + SLICE, len(data))
        while not _is_space(data[end - 1]):  # the last byte is one
            found = np.flatnonzero(_is_space(data[end : end + SLICE]))
            end = end + int(found[0]) + 1 if len(found) else min(end + SLICE, len(data))
        first, own = _slice_hashes(data[at:end])
        starts.append(first + at)
        hashes.append(own)
        at = end
    edges = np.searchsorted(np.concatenate(starts), np.cumsum([0, *(len(t) + 1 for t in lowered)]))  # of each text's words
    return np.concatenate(hashes), edges


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def _slice_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of each word in bytes that begin and end between words."""
    space = _is_space(data)
    first = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    if not len(first):
        return first, np.zeros(0, np.uint64)
    at = np.arange(len(data))
    at[first[0] :] -= np.repeat(first, np.diff(np.append(first, len(data))))  # place in the word
    at[space] = 0
    powers = np.multiply.accumulate(np.full(int(at.max()) + 1, _M(0xD6E8FEB86659FD93)))
    values = BYTE_VALUES[data] * powers[at]
    values[space] = 0
    return first, mix(np.add.reduceat(values, first))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text (UTF-8)."""
    words, edges = word_hashes(texts)
    out = [np.zeros(0, np.uint64)] * len(texts)
    if len(words) >= k:
        grams = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            grams = (grams + words[j : j + len(grams)]) * (ODD + _M(2 * j))
        grams = mix(grams)
    for i in range(len(texts)):
        a, b = int(edges[i]), int(edges[i + 1])
        if b - a >= k:
            out[i] = np.unique(grams[a : b - k + 1])
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for j in range(a, b):
                whole = (whole ^ words[j : j + 1]) * (ODD + _M(64 + 2 * (b - a)))
            out[i] = mix(whole)
    return out


class Scheme:
    """Boundary, size classes, blocks and signatures for one threshold num / den."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        self.boundary = next(n for n in range(2, 64) if self.subsets(n, 64) > self.postings(n))

    def least(self, b: int) -> int:
        """The smallest size that links with b."""
        return -(-self.num * b // self.den)

    def common(self, a: int, b: int) -> int:
        """Elements that linked sets of these sizes share at least."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def partners(self, n: int, below: int):
        return [b for b in range(self.least(n), min(self.den * n // self.num, below - 1) + 1) if self.common(n, b) <= min(n, b)]

    def subsets(self, n: int, below: int) -> int:
        return sum(comb(n, self.common(n, b)) for b in self.partners(n, below))

    def blocks(self, largest: int) -> tuple[int, int]:
        """(blocks, slack) for sets whose smaller one has at most so many elements."""
        differ = largest * (self.den - self.num) // self.num
        slack = 1 + (differ + 1) // 32
        return differ + 1 + slack, slack

    def postings(self, n: int) -> int:
        return 2 * self.blocks(n)[0]

    @cache
    def classes(self, upto: int) -> list[int]:
        """Lower borders of the size classes of inverted lists: linked sets are in one class or in neighbours."""
        borders = [self.least(self.boundary)]
        while borders[-1] <= upto:
            borders.append(self.den * borders[-1] // self.num + 1)
        return [*borders, self.den * borders[-1] // self.num + 1]

    @staticmethod
    @cache
    def thresholds(blocks: int) -> np.ndarray:
        return np.array([(j << 64) // blocks for j in range(1, blocks)], np.uint64)

    def signatures(self, s: np.ndarray) -> np.ndarray:
        """What the set s (sorted) is found by. Different kinds and classes never meet."""
        n, out = len(s), []
        if not n:
            return np.zeros(0, np.uint64)
        parts = mix(s ^ ODD)
        if n < self.boundary:
            for b in self.partners(n, self.boundary):
                tag = _M((min(n, b) << 32 | max(n, b)) * int(ODD) % (1 << 64))
                picks = np.array(list(combinations(range(n), self.common(n, b))))
                out.append(mix(parts[picks].sum(1, dtype=np.uint64) + tag))
        if n >= self.least(self.boundary):
            borders = self.classes(1 << (n - 1).bit_length())
            own = int(np.searchsorted(borders, n, "right")) - 1
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(parts, dtype=np.uint64)])
            for c in (own, own - 1):
                if c < 0:
                    continue
                blocks, slack = self.blocks(borders[c + 1] - 1)
                cuts = np.concatenate([[0], np.searchsorted(s, self.thresholds(blocks)), [n]])
                full = np.flatnonzero(np.diff(cuts))
                content = sums[cuts[full + 1]] - sums[cuts[full]]
                out.append(mix(mix(content + full.astype(np.uint64) * ODD) + _M(c + 1)))
                if blocks - len(full) > slack:
                    out.append(mix(parts[: n - self.least(n) + 1] ^ _M(0xA5A5A5A5A5A5A5A5)))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def set_key(s: np.ndarray) -> int:
    """Names a set; 0 is the empty one. As a signed integer."""
    if not len(s):
        return 0
    return int(mix(np.array([np.add.reduce(mix(s ^ _M(0x5851F42D4C957F2D)), dtype=np.uint64) + _M(len(s))], np.uint64)).view(np.int64)[0])


def _blocks(batches):
    """(ids, texts) of at most about BLOCK_BYTES."""
    for batch in batches:
        ids, texts, held = [], [], 0
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            held += len(t or b"")
            if held > BLOCK_BYTES:
                yield ids, texts
                ids, texts, held = [], [], 0
        if ids:
            yield ids, texts


ROW = ["is_doc", "sig", "key", "n"]


def _rows(is_doc, sig, key, n):
    return pa.RecordBatch.from_arrays([pa.array(is_doc, pa.bool_()), pa.array(sig, pa.int64()), pa.array(key, pa.int64()), pa.array(n, pa.int32())], ROW)


def lists(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """One scan and one shuffle: a row (is_doc, doc_id, key, n) of each document, and the rows (signature, key, n, lo) of each list that different sets share; lo is the list's smallest key."""
    scheme = Scheme(num, den)

    def run(batches):
        for ids, texts in _blocks(batches):
            sets = shingle_sets(texts, k)
            keys = [set_key(s) for s in sets]
            yield _rows([True] * len(ids), ids, keys, [len(s) for s in sets])
            once = dict(zip(keys, sets, strict=True))  # copies post once a block
            sigs = [(key, len(s), scheme.signatures(s)) for key, s in once.items() if len(s)]
            if sigs:
                count = [len(x) for _, _, x in sigs]
                yield _rows(np.zeros(sum(count), bool), np.concatenate([x for _, _, x in sigs]).view(np.int64), np.repeat(np.array([x for x, _, _ in sigs], np.int64), count), np.repeat(np.array([x for _, x, _ in sigs], np.int32), count))

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(lean(run), "is_doc boolean, sig long, key long, n int")
    by_size = Window.partitionBy("sig", "is_doc").orderBy("n")
    each = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("lo", F.min("key").over(each)).withColumn("hi", F.max("key").over(each))
    # a member that is too large for the next smaller one and too small for the next larger one links with none of its list
    rows = rows.withColumn("less", F.lag("n").over(by_size)).withColumn("more", F.lead("n").over(by_size))
    fitting = (F.col("less") * den >= F.col("n") * num) | (F.col("n") * den >= F.col("more") * num)
    return materialise(rows.where(F.col("is_doc") | ((F.col("lo") < F.col("hi")) & F.coalesce(fitting, F.lit(False)))).drop("hi", "less", "more"), "lists")


def wanted_filter(pairs: DataFrame) -> np.ndarray:
    """A bit for each key of ``pairs`` (a, b), folded into FILTER_BITS: at most FILTER_BITS / 64 words come to the driver."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    words = keys.select(F.pmod("key", F.lit(FILTER_BITS)).alias("bit")).selectExpr("cast(bit div 64 as int) as word", "shiftleft(1L, cast(bit % 64 as int)) as mask").groupBy("word").agg(F.bit_or("mask").alias("mask"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    for batch in words.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def sets_of(docs: DataFrame, pairs: DataFrame, k: int) -> str:
    """The name of a table (key, elements) of the sets in ``pairs`` (and of few others), by one more scan. With more keys than the filter has room for the others are more, up to all."""
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_filter(pairs))

    def run(batches):
        bits = wanted.value
        for _, texts in _blocks(batches):
            found = {}
            for s in shingle_sets(texts, k):
                bit = (key := set_key(s)) % FILTER_BITS
                if len(s) and int(bits[bit >> 6]) >> (bit & 63) & 1:
                    found[key] = s.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(found.values(), pa.binary())], ["key", "elements"])

    rows = docs.select("doc_id", F.col("text").cast("binary")).mapInArrow(lean(run), "key long, elements binary")
    return bucketed(rows.groupBy("key").agg(F.min("elements").alias("elements")), "sets", "key")


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that link."""
    # the first members are few and may be in many pairs: theirs is a table of its own, so that its join can be split
    left = materialise(pairs.select(F.col("a").alias("key")).distinct().join(sets.hint("merge"), "key").select(F.col("key").alias("a"), F.col("elements").alias("ea")), "heads")
    right = sets.select(F.col("key").alias("b"), F.col("elements").alias("eb"))
    both = pairs.select("a", "b").join(right.hint("merge"), "b").join(left.hint("merge"), "a").select("a", "b", "ea", "eb")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * shared >= num * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(lean(run), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """(key, comp) of all keys in ``links`` (a, b): comp is the smallest key that links reach. Labels spread along links and then jump to their own label's label."""
    edges = materialise(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    now = materialise(edges.groupBy(F.col("a").alias("key")).agg(F.min("b").alias("m")).select("key", F.least("key", "m").alias("comp")), "labels")
    while True:
        near = edges.join(now.select(F.col("key").alias("a"), F.col("comp").alias("c")).hint("merge"), "a").groupBy(F.col("b").alias("key")).agg(F.min("c").alias("c"))
        step = now.join(near.hint("merge"), "key").select("key", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        step = materialise(step, "labels")
        jump = step.select(F.col("key").alias("comp"), F.col("comp").alias("further"))
        after = materialise(step.join(jump.hint("merge"), "comp", "left").select("key", "old", F.least("comp", F.coalesce("further", "comp")).alias("comp")), "labels")
        now = after.select("key", "comp")
        if after.where("comp < old").isEmpty():
            return now


def fits(a: str, b: str, num: int, den: int):
    """Whether sets of these sizes can link."""
    return (F.col(a) * den >= F.col(b) * num) & (F.col(b) * den >= F.col(a) * num)


def cross_pairs(rows: DataFrame, list_column: str, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of members (key, n, comp) of one list that are in different components."""
    x = rows.select(list_column, F.col("key").alias("a"), F.col("n").alias("na"), F.col("comp").alias("ca"))
    y = rows.select(list_column, F.col("key").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"))
    return x.join(y.hint("merge"), list_column).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & fits("na", "nb", num, den)).select("a", "b")


def rare_postings(keys: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Inverted lists (element, key, n, comp, rank) of the sets ``keys`` by their rarest elements.

    Linked sets share one of the first n - least(n) + 1 elements of each, in any
    order that is the same for all. Rarest first, a set with many elements of its
    own posts none that others have, so the versions of one text that have drifted
    apart don't meet, although they share most of it.
    """

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                e = np.frombuffer(data.as_buffer(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(e), pa.array(np.full(len(e), key.as_py()))], ["element", "key"])

    rows = keys.select("key").join(sets.hint("merge"), "key").select("key", "elements").mapInArrow(lean(run), "element long, key long")
    df = F.count("*").over(Window.partitionBy("element"))
    shared = materialise(rows.withColumn("df", df).where("df > 1"), "shared")  # an element of one set alone is in no list, and only moves the others back
    own = Window.partitionBy("key")
    rank = F.col("n") - F.count("*").over(own) + F.row_number().over(own.orderBy("df", "element"))
    posted = shared.join(keys.hint("merge"), "key").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * num / den) + 1)
    return materialise(posted.select("element", "key", "n", "comp", "rank"), "postings")


def rare_pairs(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) from different components that share a posted element and can still link.

    The smaller set of a pair needs only its first n - common(n, n) + 1 elements;
    and what follows the first shared element on either side has to hold the rest
    of the overlap that a link demands.
    """
    half = F.ceil(F.lit(num) * 2 * F.col("n") / (num + den))
    x = posted.where(F.col("rank") <= F.col("n") - half + 1).select("element", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("comp").alias("cx"), F.col("rank").alias("rx"))
    y = posted.select("element", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("comp").alias("cy"), F.col("rank").alias("ry"))
    order = (F.col("nx") < F.col("ny")) | ((F.col("nx") == F.col("ny")) & (F.col("x") < F.col("y")))
    left = 1 + F.least(F.col("nx") - F.col("rx"), F.col("ny") - F.col("ry"))
    can = (F.col("cx") != F.col("cy")) & (F.col("nx") * den >= F.col("ny") * num) & (left * (num + den) >= (F.col("nx") + F.col("ny")) * num)
    return x.join(y.hint("merge"), "element").where(order & can).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def link_sets(docs: DataFrame, found: DataFrame, k: int, num: int, den: int) -> DataFrame | None:
    """(key, comp) of the sets that link with others; None if there are no lists."""
    members = found.where("not is_doc").select("sig", "key", "n", "lo")
    # round one: the smallest set that each set meets
    first = materialise(members.where("lo < key").groupBy(F.col("key").alias("b")).agg(F.min("lo").alias("a")), "pairs")
    if first.isEmpty():
        return None
    name = sets_of(docs, members.select(F.col("lo").alias("a"), F.col("key").alias("b")), k)
    try:
        return linked(members, first, docs.sparkSession.table(name), num, den)
    finally:
        docs.sparkSession.sql(f"DROP TABLE {name}")


def linked(members: DataFrame, first: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(key, comp) from lists (``members``), the pairs of round one and the sets themselves."""
    links = verify(first, sets, num, den)
    compared, comps = first, components(links)

    def conflicts():
        """Members of lists that hold several components, with their component."""
        label = members.join(comps.hint("merge"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        each = Window.partitionBy("sig")
        label = label.withColumn("low", F.min("comp").over(each)).withColumn("high", F.max("comp").over(each))
        return materialise(label.where("low < high").select("sig", "key", "n", "lo", "comp").distinct(), "conflicts")

    # round two: the smallest member of each such list
    open_lists = conflicts()
    heads = open_lists.where("key = lo").select("sig", F.col("n").alias("lo_n"), F.col("comp").alias("lo_comp"))
    pairs = open_lists.join(heads.hint("merge"), "sig").where((F.col("comp") != F.col("lo_comp")) & fits("n", "lo_n", num, den))
    pairs = pairs.select(F.col("lo").alias("a"), F.col("key").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
    second = materialise(pairs, "pairs")
    if not second.isEmpty():
        more = verify(second, sets, num, den)
        compared = compared.select("a", "b").union(second.select("a", "b"))
        if not more.isEmpty():
            links = links.union(more)
            comps = components(links)
            open_lists = conflicts()
    # round three: what is left between different components of a list
    size = F.count("*").over(Window.partitionBy("sig"))
    open_lists = open_lists.withColumn("members", size)
    few = open_lists.where(F.col("members") <= FEW)
    pairs = cross_pairs(few, "sig", num, den)
    many = materialise(open_lists.where(F.col("members") > FEW).select("key", "n", "comp").distinct(), "many")
    if not many.isEmpty():
        posted = rare_postings(many, sets, num, den)
        # each member against the one of its list that has the fewest elements of its own
        hubs = posted.groupBy("element").agg(F.min(F.struct("rank", "key", "n", "comp")).alias("h")).select("element", F.col("h.key").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.comp").alias("hub_comp"))
        spokes = materialise(hubs, "hubs").hint("merge").join(posted, "element").where((F.col("comp") != F.col("hub_comp")) & fits("n", "hub_n", num, den))
        spokes = spokes.select(F.least("hub", "key").alias("a"), F.greatest("hub", "key").alias("b")).distinct().join(compared, ["a", "b"], "left_anti")
        spokes = materialise(spokes, "pairs")
        more = verify(spokes, sets, num, den)
        compared = compared.select("a", "b").union(spokes.select("a", "b"))
        if not more.isEmpty():
            links = links.union(more)
            comps = components(links)
            posted = posted.join(comps.withColumnRenamed("comp", "now").hint("merge"), "key", "left").withColumn("comp", F.coalesce("now", "comp")).drop("now")
            posted = materialise(posted, "postings")
        pairs = pairs.unionByName(rare_pairs(posted, num, den))
    third = materialise(pairs.distinct().join(compared, ["a", "b"], "left_anti"), "pairs")
    if not third.isEmpty():
        more = verify(third, sets, num, den)
        if not more.isEmpty():
            comps = components(links.union(more))
    return comps


def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of ``docs``: the smallest doc_id that links reach."""
    found = lists(docs, k, num, den)
    rows = found.where("is_doc").select(F.col("sig").alias("doc_id"), "key", "n")
    comps = link_sets(docs, found, k, num, den)
    names = rows.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("smallest"))
    if comps is None:
        names = names.withColumnRenamed("smallest", "component_id")
    else:
        names = names.join(comps.hint("merge"), "key", "left").withColumn("comp", F.coalesce("comp", "key"))
        least = materialise(names.groupBy("comp").agg(F.min("smallest").alias("component_id")), "components")
        names = names.join(least.hint("merge"), "comp").select("key", "component_id")
    names = materialise(names, "names")
    # sets without elements link with nothing: they have keys of their own in this join
    full = rows.where("n > 0").join(names.hint("merge"), "key")
    empty = rows.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(empty)


def op6_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Four words a shingle, a Jaccard similarity of 0.85 or more."""
    return near_duplicates(table(spark, sf_dir, "documents"), 4, 85, 100)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END) AS g FROM d
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT s.doc_id, s.g, n.n, count(*) OVER (PARTITION BY g) AS df FROM s JOIN n USING (doc_id)),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i, any_value(a.n) AS nx, any_value(b.n) AS ny
      FROM k a JOIN k b ON a.g = b.g AND a.doc_id <> b.doc_id AND a.df > 1 AND b.df > 1 GROUP BY 1, 2),
l AS (SELECT x, y FROM p WHERE 100 * i >= 85 * (nx + ny - i)),
r AS (
  WITH RECURSIVE reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x) SELECT x, min(y) AS m FROM reach GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(r.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.x = d.doc_id
"""
