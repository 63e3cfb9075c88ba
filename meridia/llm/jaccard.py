"""N-gram Jaccard join by prefix trees, and the components of its links.

Two documents link when their sets of five-word shingles have a Jaccard likeness of at
least ``NUMERATOR / DENOMINATOR``. The join is exact:

1. Every text becomes its set of 64-bit shingle hashes and, from it, its size, a 128-bit
   digest and its *profile*: the least hashes, so many that two linked sets have a tenth of
   their shingles in common there. Of texts with equal sets only one is compared.
2. Profiles are counted by shingle; a set goes on only if it shares enough of its profile with
   others to link with any of them. Documents with a shared passage or two leave here.
3. The sets that are left are put in the order of how many sets have a shingle, rarest first. A
   set's prefix is its first ``n - ceil(n * t) + 1`` shingles; two sets that link share a
   shingle of both prefixes. Sets are joined to the least of a shingle's sharers (a star, not all
   pairs), and the stars' components are closed under linking.
4. Each component's sets go to one task, or in blocks of bounded size to several. There
   they are ordered anew and parted by shared prefixes once more; what is left is stored in a
   trie. Each set walks it with its overlap so far, and leaves a subtree, unread, when the
   lengths still to come (of the subtree and of the set's own rest) cannot reach the overlap
   needed. Sets already known to be connected are not compared again.

Edge cases: null, empty and wordless texts have an empty set, link with nothing and are
their own component; texts with fewer than five words have one shingle, their whole word
sequence; rows with one doc_id are one document, which has the links of all its texts and the
size of its largest set; null ids count as the least
possible id within and come back as null.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from meridia.llm.common import MULT, code_points, discard, limit_batches, materialise, maybe_in, mix64, shuffle_partitions, small, text_chunks

WIDTH = 5
NUMERATOR, DENOMINATOR = 80, 100
BLOCK_CHARS = 8_000_000  # characters of a component that one task holds
SHARE = 10  # one in so many shingles of a set must be shared in its profile
NONE_ID = -(2**63)
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x20\x09-\x0D]+")

_INVERSE = np.uint64(pow(int(MULT), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """MULT ** i and MULT ** -i (mod 2 ** 64), i below n at least."""
    if len(_powers.get("up", ())) < n:
        n = max(n, 1 << 20)
        for name, base in (("up", MULT), ("down", _INVERSE)):
            full = np.full(n, base, np.uint64)
            full[0] = 1
            _powers[name] = np.cumprod(full, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def shingles(texts: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text, concatenated, and n + 1 offsets. Each set is sorted by hash."""
    points, offsets = code_points(texts)
    points = points.copy()
    upper = (points >= 65) & (points <= 90)
    points[upper] += np.uint32(32)
    word = ~((points == 32) | ((points >= 9) & (points <= 13)))
    before = np.concatenate([[False], word[:-1]])
    first = np.zeros(len(points), bool)
    first[offsets[:-1][offsets[:-1] < len(points)]] = True
    starts = np.flatnonzero(word & (~before | first))
    after = np.concatenate([word[1:], [False]])
    last = np.zeros(len(points), bool)
    ends_at = offsets[1:] - 1
    last[ends_at[ends_at >= 0]] = True
    ends = np.flatnonzero(word & (~after | last)) + 1
    up, down = _power_table(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])
    words = mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.searchsorted(starts, offsets)  # of each text's words
    counts = np.diff(bounds)
    hashes = np.zeros(len(words), np.uint64)
    for k in range(width):
        shifted = np.zeros_like(words)
        shifted[: len(words) - k] = words[k:] if k else words
        hashes = mix64(hashes + shifted + np.uint64(k + 1))
    owner = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(words)) - bounds[owner]
    whole = place + width <= counts[owner]
    out, owner = hashes[whole], owner[whole]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        own = []
        for i in short:
            h = counts[i : i + 1].astype(np.uint64)
            for k in range(bounds[i], bounds[i + 1]):
                h = mix64(h + words[k : k + 1])
            own.append(h)
        out, owner = np.append(out, np.concatenate(own)), np.append(owner, short)
    order = np.lexsort((out, owner))
    out, owner = out[order], owner[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    out, owner = out[new], owner[new]
    return out, np.searchsorted(owner, np.arange(len(texts) + 1))


def needed(n: int) -> int:
    """The least size of the other set that can link with a set of n, and with equality of sizes the least overlap."""
    return -(-NUMERATOR * n // DENOMINATOR)


def overlap_needed(a, b):
    """The least overlap with which sets of sizes a and b link: 100 o >= 80 (a + b - o)."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def _digest_columns(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set."""
    if not len(s):
        return 0, 0
    at = np.arange(1, len(s) + 1, dtype=np.uint64)
    a = np.bitwise_xor.reduce(mix64(s * MULT + at))
    b = np.add.reduce(mix64(s ^ (at * MULT)), dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix_size(n, share: int = 1):
    """How many of a set's first shingles, in any one order, hold ``share`` shingles of every set that it links with."""
    return n - needed(n) + share


def share_of(n: int) -> int:
    """Shingles that a set of n and any linked set of at least its size have in common in their profiles."""
    return max(1, n // SHARE)


def profiles(rows: DataFrame) -> DataFrame:
    """(id, n_shingles, d1, d2, profile): sizes and digests of the sets, and each set's least hashes.

    Two linked sets of a and b shingles share ``share_of(min(a, b))`` hashes of their profiles at least.
    """

    def run(batches):
        for batch, texts in text_chunks(batches, limit=1_000_000):
            all_, offsets = shingles(texts)
            found = [_digest_columns(all_[a:b]) for a, b in zip(offsets, offsets[1:])]
            n = np.diff(offsets)
            kept = np.array([prefix_size(k, share_of(k)) if k else 0 for k in n.tolist()], np.int64)
            place = np.arange(len(all_)) - np.repeat(offsets[:-1], n)
            own = all_[place < np.repeat(kept, n)].view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), pa.array(own))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array([d[0] for d in found], pa.int64()), pa.array([d[1] for d in found], pa.int64()), lists], ["id", "n_shingles", "d1", "d2", "profile"])

    return rows.mapInArrow(run, "id long, n_shingles long, d1 long, d2 long, profile array<long>")


def every_shingle(rows: DataFrame) -> DataFrame:
    """(id, shingle) of whole sets."""

    def run(batches):
        for batch, texts in text_chunks(batches, limit=1_000_000):
            all_, offsets = shingles(texts)
            ids = np.repeat(batch.column(0).to_numpy(), np.diff(offsets))
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(all_.view(np.int64))], ["id", "shingle"])

    return rows.mapInArrow(run, "id long, shingle long")


def sharing(found: DataFrame, copies: DataFrame) -> DataFrame:
    """(id) of the sets that share enough of their profile with others to link with any; ``copies``: ids to leave out."""
    rows = found.where("n_shingles > 0").join(copies, "id", "left_anti").select("id", F.explode("profile").alias("shingle"))
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("shingle")
    hits = rows.join(shared, "shingle").groupBy("id").agg(F.count(F.lit(1)).alias("hits"))
    # the least set that links with one of n has needed(n) shingles
    least = F.ceil(F.col("n_shingles") * F.lit(NUMERATOR) / F.lit(DENOMINATOR))
    enough = F.greatest(F.lit(1), F.floor(least / F.lit(SHARE)))
    return hits.join(found.select("id", "n_shingles"), "id").where(F.col("hits") >= enough).select("id")


def stars(texts: DataFrame) -> DataFrame:
    """(a, b): each set with the least id that shares a shingle of its prefix; sets are in the order of how many have a shingle.

    Rarest first, a shingle that no other set has fills a place of the prefix, so passages that
    documents share chain only those that consist of little else.
    """
    rows = every_shingle(texts)
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    sizes = rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"))  # within tasks: a set's rows come from one
    listed = rows.join(common, "shingle").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("shared"))  # of one text
    lone = F.col("n") - F.size("shared")
    least = F.ceil(F.col("n") * F.lit(NUMERATOR) / F.lit(DENOMINATOR))
    room = (F.col("n") - least + 1 - lone).cast("int")
    prefix = listed.join(sizes, "id").where(room > 0).select("id", F.explode(F.slice("shared", F.lit(1), room)).alias("s")).select("id", "s.shingle")
    prefix = materialise(prefix, "prefixes")
    heads = prefix.groupBy("shingle").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("shingle", "a")
    return prefix.join(heads, "shingle").where("a <> id").select("a", F.col("id").alias("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of the nodes of ``edges``: the least id reachable. Large-star and small-star rounds."""
    e = materialise(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    sums = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.where("u <> v").distinct(), "large")
        old = e
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = materialise(small.where("u <> v").distinct(), "small")
        discard(old, large)
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == sums:
            break
        sums = now
    least = e.groupBy("u").agg(F.min("v").alias("component"))
    roots = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return least.select(F.col("u").alias("id"), "component").unionByName(roots).groupBy("id").agg(F.min("component").alias("component"))


class Trie:
    """Sets in one order, as a radix tree in arrays: a node is a run of codes shared by all sets below.

    ``sets`` are sorted codes, ``sizes`` count the shingles that no other set has too. Nodes are
    numbered by level and a node's children are neighbours, so a walk keeps a frontier of live
    nodes, and below a node that is given up nothing is read.
    """

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        self.sets, self.sizes = sets, sizes
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.ranked = np.array(sorted(range(len(sets)), key=keys.__getitem__))
        lengths = np.array([len(s) for s in sets])
        nodes, runs, level = [], [], [(0, len(sets), 0)]
        while level:
            following = []
            base = len(nodes) + len(level)  # the number of the next level's first node
            for lo, hi, depth in level:
                one, other = sets[self.ranked[lo]], sets[self.ranked[hi - 1]]
                n = min(len(one), len(other))
                unlike = np.flatnonzero(one[depth:n] != other[depth:n])
                end, mid = depth + int(unlike[0]) if len(unlike) else n, lo
                below = self.ranked[lo:hi]
                while mid < hi and lengths[self.ranked[mid]] == end:
                    mid += 1
                born = base + len(following)
                if mid < hi:
                    heads = np.array([sets[k][end] for k in self.ranked[mid:hi]])
                    cuts = np.append(np.flatnonzero(np.append(True, heads[1:] != heads[:-1])), hi - mid) + mid
                    following += [(int(x), int(y), end) for x, y in zip(cuts, cuts[1:])]
                run = one[depth:end]
                runs.append(run)
                nodes.append((sizes[below].min(), sizes[below].max(), lengths[below].max(), depth, end, lo, mid, born, base + len(following), run[0] if len(run) else 0, run[-1] if len(run) else -1))
            level = following
        self.low, self.high, self.reach, self.depth, self.end, self.sets_from, self.sets_to, self.born, self.bred, self.first, self.last = np.array(nodes).T
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
        self.flat = np.concatenate(runs)
        self.read = 0  # codes that walks have looked at

    def links(self, i: int) -> np.ndarray:
        """The sets that link with set i (itself among them)."""
        probe, size = self.sets[i], int(self.sizes[i])
        least, most, n = needed(size), size * DENOMINATOR // NUMERATOR, len(probe)
        node, overlap, found = np.zeros(1, np.int64), np.zeros(1, np.int64), []
        while len(node):
            # what is still to come below, and what the probe has left from here on, bound the overlap
            left = n - np.searchsorted(probe, self.first[node])
            wanted = overlap_needed(size, np.maximum(self.low[node], least))
            live = (self.high[node] >= least) & (self.low[node] <= most) & (overlap + np.minimum(self.reach[node] - self.depth[node], left) >= wanted)
            node, overlap, wanted = node[live], overlap[live], wanted[live]
            if not len(node):
                break
            lengths = self.end[node] - self.depth[node]
            ends = np.cumsum(lengths)
            codes = self.flat[_ranges(self.starts[node], lengths)]
            self.read += len(codes)
            at = np.searchsorted(probe, codes)
            hits = np.concatenate([[0], np.cumsum(probe[np.minimum(at, n - 1)] == codes)])
            overlap = overlap + hits[ends] - hits[ends - lengths]
            here = self.sets_to[node] - self.sets_from[node]
            done = self.ranked[_ranges(self.sets_from[node], here)]
            found.append(done[np.repeat(overlap, here) >= overlap_needed(size, self.sizes[done])])
            left = n - np.searchsorted(probe, self.last[node], "right")
            live = overlap + np.minimum(self.reach[node] - self.end[node], left) >= wanted
            children = (self.bred[node] - self.born[node]) * live
            node, overlap = _ranges(self.born[node], children), np.repeat(overlap, children)
        return np.concatenate(found) if found else np.zeros(0, np.int64)


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def narrowed(codes: np.ndarray, sizes: np.ndarray) -> tuple[list[np.ndarray], list[list[int]]]:
    """Sets held together, as codes in the order of how many sets have them, and the groups within which links can be.

    ``codes``: the sets one after another, as numbers. Codes that no other set has fill the first
    places of the prefix and are left out of the sets then.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    df = np.bincount(codes)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(df))
    lone = int((df == 1).sum())
    codes = rank[codes]
    order = np.lexsort((codes, owner))
    codes = codes[order]  # owner is in order already
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = (place < prefix_size(sizes)[owner]) & (codes >= lone)
    marks, at = codes[prefix], owner[prefix]
    by = np.lexsort((at, marks))
    marks, at = marks[by], at[by]
    first = np.append(True, marks[1:] != marks[:-1]) if len(marks) else np.zeros(0, bool)
    head = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))] if len(at) else at
    parent = list(range(len(sizes)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    pairs = np.unique(head.astype(np.int64) * len(sizes) + at)
    for x, y in zip((pairs // len(sizes)).tolist(), (pairs % len(sizes)).tolist()):
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for i in range(len(sizes)):
        groups.setdefault(find(i), []).append(i)
    kept = codes >= lone
    cuts = np.cumsum(np.bincount(owner[kept], minlength=len(sizes)))[:-1]
    return np.split(codes[kept].astype(np.int32), cuts), [g for g in groups.values() if len(g) > 1]


def link_sets(ids: list[int], sets: list[np.ndarray], labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that span the components of ``sets``, group by group of those that can link at all.

    Sets with equal ``labels`` are connected already.
    """
    sizes = np.array([len(s) for s in sets])
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    ordered, groups = narrowed(codes, sizes)
    named = np.unique(labels, return_inverse=True)[1] if labels is not None else np.arange(len(sets))
    return [x for g in groups for x in link_group([ids[i] for i in g], [ordered[i] for i in g], sizes[g], named[g])]


def link_group(ids: list[int], sets: list[np.ndarray], sizes: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the components of a group.

    Sets whose codes are the most common walk the trie first, as the middle of a group of
    copies connects it at once; a set is passed over once all sets of fitting size are
    connected with it.
    """
    own, out = labels.copy(), []
    if (own == own[0]).all():
        return out
    trie = Trie(sets, sizes)
    counts = np.bincount(np.concatenate(sets))
    common = np.array([counts[s].sum() for s in sets]) / sizes
    for i in np.argsort(-common, kind="stable"):
        size = int(sizes[i])
        fitting = (sizes >= needed(size)) & (sizes <= size * DENOMINATOR // NUMERATOR)
        if (own[fitting] == own[i]).all():
            continue
        for j in trie.links(int(i)):
            if own[j] != own[i]:
                own[own == own[j]] = own[i]
                out.append((ids[i], ids[j]))
    return out


def sets_of(texts: list[str], limit: int = 500_000) -> list[np.ndarray]:
    """The sets of many texts; the arrays behind them take 60 bytes a character, so they are made ``limit`` characters at a time."""
    sets, chunk, size = [], [], 0
    for k, t in enumerate(texts):
        chunk.append(t)
        size += len(t)
        if size > limit or k == len(texts) - 1:
            all_, offsets = shingles(chunk)
            sets += [all_[a:b] for a, b in zip(offsets, offsets[1:])]
            chunk, size = [], 0
    return sets


def joined_blocks(rows: DataFrame, block_chars: int) -> DataFrame:
    """(a, b): links that span the labels within each (component, block); ``rows``: component, block, probe, id, label, text.

    A task holds one block's members and as many probes at once; probes pass by.
    """

    def run(batches):
        key, members, probes, size = None, [], [], 0

        def compare():
            both = members + probes
            probes.clear()
            if len(both) < 2:
                return
            found = link_sets([r[0] for r in both], sets_of([r[2] for r in both]), [r[1] for r in both])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

        waiting = False
        for batch in batches:
            for component, block, probe, doc, label, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (component, block) != key:
                    if waiting:
                        yield from compare()
                    key, size, waiting = (component, block), 0, False
                    members.clear()
                (probes if probe else members).append((doc, label, text or ""))
                waiting = True
                size += len(text or "") if probe else 0
                if size > block_chars:
                    yield from compare()
                    size, waiting = 0, False
        if waiting:
            yield from compare()

    placed = rows.select("component", "block", "probe", "id", "label", "text")
    n = shuffle_partitions(rows.sparkSession)
    return placed.repartition(n, "component", "block").sortWithinPartitions("component", "block", "probe", "id").mapInArrow(run, "a long, b long")


def linked(texts: DataFrame, candidates: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(a, b): links that span the components of the link graph. ``texts``: stored (id, text); ``candidates``: (id, component).

    A component of up to ``block_chars`` characters is joined by one task. A larger one is dealt into
    blocks by a hash: each block is joined in itself and with a few hubs of the component, which
    connects groups of copies; then the documents that are not connected with most of the
    component visit every block. So a block is bounded in bytes, and rows grow with the documents
    that are like the others but linked with few.
    """
    placed = texts.select("id", F.length("text").alias("chars")).join(candidates, "id")
    sizes = placed.groupBy("component").agg(F.sum(F.col("chars") + 1).alias("chars"), F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = sizes.select("component", F.ceil(F.col("chars") / F.lit(block_chars)).cast("int").alias("blocks"))
    hashed = F.xxhash64("id")
    placed = materialise(placed.select("id", "component").join(sizes, "component").withColumn("block", F.pmod(hashed, F.col("blocks")).cast("int")), "placed")
    many = placed.where("blocks > 1")
    hubs = many.groupBy("component", "blocks").agg(F.min_by(F.struct("id", "block"), hashed).alias("h"), F.max_by(F.struct("id", "block"), hashed).alias("g"))
    hubs = hubs.select("component", "blocks", F.explode(F.array("h", "g")).alias("h")).select("component", F.col("h.id").alias("id"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("h.block").alias("own"))
    hubs = hubs.where("block <> own").drop("own")
    own = placed.select("component", "id", "block").unionByName(hubs).withColumns({"probe": F.lit(0), "label": F.col("id")})
    inner = joined_blocks(own.join(texts, "id"), block_chars)
    if many.isEmpty():
        return inner
    inner = materialise(inner, "inner")
    label = F.coalesce("top", "id")
    labelled = many.join(components(inner).withColumnRenamed("component", "top"), "id", "left").select("id", "component", "blocks", "block", label.alias("label"))
    labelled = materialise(labelled, "labelled")
    most = labelled.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("label", F.struct("n", "label")).alias("main"))
    apart = labelled.join(most, "component").where("label <> main")
    visits = apart.select("component", "id", "label", F.col("block").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).where("block <> own").drop("own")
    rows = labelled.select("component", "id", "label", "block").withColumn("probe", F.lit(0)).unionByName(visits.withColumn("probe", F.lit(1)))
    return inner.unionByName(joined_blocks(rows.join(texts, "id"), block_chars))


def with_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(id, text) with an id of its own for each row, and (id, doc) of documents with several rows.

    Where doc_id is unique it is the row's id. Else different texts of one doc_id become rows of a stored table.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE_ID)).alias("id"), "text")
    if keyed.groupBy("id").count().where("count > 1").isEmpty():
        return keyed, None
    rows = keyed.distinct().select(F.col("id").alias("doc"), "text")
    rows = materialise(rows.withColumn("id", F.monotonically_increasing_id()), "rows")
    return rows.select("id", "text"), rows.select("id", "doc")


def components_of(docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(_id, n_shingles, component_id): one row per document id."""
    limit_batches(docs.sparkSession)
    rows, owners = with_rows(docs)
    found = materialise(profiles(rows), "profiles")
    # a class of equal sets: its least id stands for it; empty sets are in none
    filled = found.where("n_shingles > 0").select("id", "n_shingles", "d1", "d2")
    classes = filled.groupBy("d1", "d2", "n_shingles").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    classes = small(materialise(classes, "classes"))
    copies = materialise(filled.join(classes, ["d1", "d2", "n_shingles"]).where("id <> rep").select("id", "rep"), "copies")
    few = materialise(sharing(found, small(copies.select("id"))), "sharing")
    texts = materialise(maybe_in(rows, "id", few).join(small(few), "id", "left_semi"), "texts")
    candidates = components(stars(texts))
    sizes = found.select("id", "n_shingles")
    links = linked(texts, materialise(candidates, "candidates"), block_chars).unionByName(copies.select(F.col("rep").alias("a"), F.col("id").alias("b")))
    if owners is not None:
        a, b = owners.select(F.col("id").alias("a"), F.col("doc").alias("x")), owners.select(F.col("id").alias("b"), F.col("doc").alias("y"))
        links = links.join(a, "a").join(b, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        sizes = sizes.join(owners, "id").groupBy(F.col("doc").alias("id")).agg(F.max("n_shingles").alias("n_shingles"))
    top = components(links).withColumnRenamed("component", "top")
    return sizes.join(top, "id", "left").select(F.col("id").alias("_id"), "n_shingles", F.coalesce("top", "id").alias("component_id"))


def query(spark: SparkSession, docs: DataFrame) -> DataFrame:
    out = components_of(docs)
    back = lambda c: F.when(F.col(c) != NONE_ID, F.col(c))
    # a row per row of the table: repeated rows come back as often as they occur
    times = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE_ID)).alias("_id")).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(times, "_id").select(back("_id").alias("doc_id"), "n_shingles", back("component_id").alias("component_id"), F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k")).drop("_k")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each group stays: the one with the least id."""
    others = small(materialise(components_of(docs).where("_id <> component_id").select("_id"), "others"))
    return docs.join(others, F.coalesce(docs["doc_id"].cast("long"), F.lit(NONE_ID)) == others["_id"], "left_anti")
