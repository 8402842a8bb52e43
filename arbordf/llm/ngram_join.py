"""N-gram Jaccard join: documents whose sets of word k-grams overlap by at least ``percent`` per cent, and their groups.

1. *Classes.* Documents with the same set become one class (a digest of the set), so copies are compared once.
2. *Inverted lists.* Tokens (64-bit hashes of k-grams) are put in one fixed order: tokens often seen twice in a block of
   text come last, others by hash. Two linked sets share a token among the first ``n - ceil(t * n) + 1`` of each, so only
   those are posted. The order decides the cost alone, any order gives the same links. At most ``LATE_TOKENS`` tokens
   are sent out as late ones.
3. *First search.* In each list, members of like size search against the one member with the fewest rarer tokens: as many
   searches as postings, however long the list. Found links are joined to components.
4. *Second search.* Only members of one list that are still in different components are compared, with the size and
   position filters, so nothing is left out: a pair in one component needs no link of its own.
5. *Search.* T-occurrence search with DivideSkip. The sets of a group are inverted once (``Inverted``: token -> members, by
   one sort). A query's lists are split; the longest ones are set aside, the short ones merged by a heap, and a member
   found often enough is probed in the long ones by binary search until it reaches the required overlap or cannot any
   more. These counts are the only ones: no intersection is taken. They are exact (up to collisions of 64-bit hashes).

What is compared within one list grows with the square of its members only as far as they are in different components
after the first search and pass the size and position filters; such a list is dealt out by the skew handling of joins.

Texts without words have an empty set and link with nothing; fewer than k words make one shingle. Null text counts as
empty. Rows with the same doc_id are one document: their classes are joined. A null doc_id has a null component. Extra
columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, temporary
from .components import connected_components
from .words import Words, blocks, lower_ascii, mix, shingle_hashes

#: Late tokens at most: the bound of what every worker gets (8 bytes each).
LATE_TOKENS = 200_000
#: Candidates that one search task compares with one query.
CANDIDATES = 64


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit k-gram hashes of each text."""
    w = Words(lower_ascii(texts))
    h = w.hashes()[w.codes] if len(w.codes) else np.empty(0, np.uint64)
    runs, bounds, out = shingle_hashes(h, k), w.bounds.tolist(), []
    for a, z in zip(bounds[:-1], bounds[1:]):
        if z - a >= k:
            out.append(np.unique(runs[a : z - k + 1]))
        elif z > a:  # the whole sequence, told apart from k-grams by its length
            out.append(mix(shingle_hashes(h[a:z], z - a) + np.uint64(z - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _rows(it, at: int = 1):
    for b in it:
        texts = b.column(at)
        for first, some in blocks(texts):
            yield b.slice(first, len(some)), some


def late_tokens(docs: DataFrame, k: int, most: int = LATE_TOKENS) -> np.ndarray:
    """Tokens that most often meet themselves within a block of documents, over all documents; sorted."""

    def meet(it):
        for _, some in _rows(it):
            sets = [s for s in shingle_sets(some, k) if len(s)]
            if sets:
                value, n = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["token", "n"])

    found = docs.select("doc_id", "text").mapInArrow(meet, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = found.orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.sort(top.column(0).to_numpy().view(np.uint64))


def _required(percent: int, sizes: int) -> int:
    """Least overlap of two sets with these sizes in sum."""
    return -(-percent * sizes // (100 + percent))


def sketch(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, at least as many bits as tokens and a power of two; as 64-bit words. Half as many bits are the
    two halves XORed."""
    bits = max(64, 1 << max(len(tokens) - 1, 0).bit_length())
    flips = np.bincount((tokens & np.uint64(bits - 1)).view(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").view(np.int64)


def signatures(docs: DataFrame, k: int, percent: int, late: np.ndarray) -> DataFrame:
    """doc_id, n (set size), key (digest of the set, null if empty), the set's first tokens in the fixed order, its sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(late)

    def sign(it):
        late = sent.value
        for b, some in _rows(it):
            n, keys, firsts, sketches = [], [], [], []
            for s in shingle_sets(some, k):
                n.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(sketch(s))
                if len(late):
                    is_late = late[np.minimum(np.searchsorted(late, s), len(late) - 1)] == s
                    s = np.concatenate([s[~is_late], s[is_late]])
                firsts.append(s[: len(s) + (percent * len(s)) // -100 + 1 if len(s) else 0].view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "n", "key", "first", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, key binary, first array<long>, sketch array<long>")


def _folded(words: Column, size: Column) -> Column:
    """A sketch brought down to ``size`` words."""
    bit = lambda i: F.aggregate(F.sequence(i, F.size(words) - 1, size), F.lit(0).cast("long"), lambda acc, j: acc.bitwiseXOR(F.get(words, j)))
    return F.when(F.size(words) == size, words).otherwise(F.transform(F.sequence(F.lit(0), size - 1), bit))


def possible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sketches allow a link; ``classes`` has (node, n, sketch), several rows for a node of several sets."""
    ends = [classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("sketch").alias(f"{x}_sketch")) for x in ("a", "b")]
    both = pairs.join(ends[0], "a").join(ends[1], "b")
    size = F.least(F.size("a_sketch"), F.size("b_sketch"))
    unlike = F.aggregate(F.zip_with(_folded(F.col("a_sketch"), size), _folded(F.col("b_sketch"), size), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    sizes = F.col("a_n") + F.col("b_n")
    overlap = F.ceil(sizes * percent / (100 + percent))
    return both.filter((overlap <= F.least("a_n", "b_n")) & (unlike <= sizes - 2 * overlap)).select("a", "b").distinct()


class Inverted:
    """Inverted lists of a group of sets: the members of each token, ascending."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate([*sets, np.empty(0, np.uint64)])
        members = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")  # members stay ascending
        self.tokens, begins = np.unique(tokens[order], return_index=True)
        self.members, self.bounds = members[order].tolist(), [*begins.tolist(), len(tokens)]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        """The lists of the query's tokens, longest first."""
        if not len(self.tokens):
            return []
        at = np.minimum(np.searchsorted(self.tokens, query), len(self.tokens) - 1)
        found = [self.members[self.bounds[i] : self.bounds[i + 1]] for i in at[self.tokens[at] == query].tolist()]
        return sorted(found, key=len, reverse=True)

    def search(self, query: np.ndarray, percent: int) -> list[int]:
        """Members that overlap ``query`` as required, by T-occurrence search."""
        need = [_required(percent, len(query) + n) if n else len(query) + 1 for n in self.sizes]
        fits = [k <= min(n, len(query)) for k, n in zip(need, self.sizes)]
        least = min((k for k, ok in zip(need, fits) if ok), default=0)
        ordered = self.lists(query)
        if not least or len(ordered) < least:
            return []
        # lists set aside: the more the required overlap exceeds what probing costs
        aside = min(int(least / (0.0085 * np.log2(max(len(ordered[0]), 2)) + 1)), least - 1)
        long_, short = ordered[:aside], ordered[aside:]
        found: list[int] = []
        current, count = -1, 0

        def settle() -> None:
            if current < 0 or not fits[current] or count < need[current] - aside:
                return
            total = count
            for j, members in enumerate(long_):
                if total >= need[current] or total + len(long_) - j < need[current]:
                    break
                at = bisect_left(members, current)
                total += at < len(members) and members[at] == current
            if total >= need[current]:
                found.append(current)

        for i in heapq.merge(*short):
            if i != current:
                settle()
                current, count = i, 0
            count += 1
        settle()
        return found


def occurrence_search(query: np.ndarray, sets: list[np.ndarray], percent: int) -> list[int]:
    """Indexes of ``sets`` that overlap ``query`` as required."""
    return Inverted(sets).search(query, percent)


def verify(pairs: DataFrame, text: DataFrame, rows: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) that are linked; a's candidates are searched ``CANDIDATES`` at a time.

    ``text`` has (doc_id, text), ``rows`` tells of a doc_id whether it has several rows: only those are moved to drop
    repeats. What is wanted of the texts is written first: its size, then known, decides how texts are joined to it.
    """
    spread = pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / CANDIDATES).cast("int").alias("parts"))
    queries = spread.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), F.col("a").alias("doc_id"))
    dealt = pairs.join(spread, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("role"), F.col("b").alias("doc_id"))
    wanted = materialize(queries.unionAll(dealt).join(rows, "doc_id"), "wanted")
    own = text.join(wanted, "doc_id").select("a", "part", "role", F.col("doc_id").alias("node"), "text", "several")
    found = own.filter("not several").drop("several").unionAll(own.filter("several").drop("several").dropDuplicates())
    found = found.repartition("a", "part").sortWithinPartitions("a", "part", "role", "node")

    def search(it):
        key, queries, nodes, sets = None, [], [], []

        def links():
            lists = Inverted(sets) if queries and nodes else None
            hits = sorted({(key[0], nodes[i]) for q in queries for i in lists.search(q, percent)}) if lists else []
            return pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["a", "b"])

        for b, some in _rows(it, 4):
            cols = [b.column(i).to_pylist() for i in range(4)]
            for a, part, role, node, s in zip(*cols, shingle_sets(some, k)):
                if (a, part) != key:
                    if nodes:
                        yield links()
                    key, queries, nodes, sets = (a, part), [], [], []
                if role:
                    nodes.append(node)
                    sets.append(s)
                else:
                    queries.append(s)
        if nodes:
            yield links()

    return found.mapInArrow(search, "a long, b long")


def jaccard_groups(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the groups that links make, by their smallest doc_id."""
    with temporary(docs.sparkSession):  # postings, texts of candidates and links go as soon as the groups are written
        return materialize(_groups(docs, k, percent), "groups", keep=True)


def _groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = materialize(signatures(text, k, percent, late_tokens(text, k)), "signatures")
    full = signed.filter("key is not null and doc_id is not null")
    classes = full.groupBy("key").agg(F.min(F.struct("doc_id", "n", "first", "sketch")).alias("c")).select(F.col("c.doc_id").alias("node"), "c.n", "c.first", "c.sketch")
    classes = materialize(classes, "classes")
    posted = classes.select("node", "n", F.posexplode("first").alias("at", "token"))
    band = F.floor(F.log("n") / -np.log(percent / 100)).alias("band")
    posted = posted.select("token", "node", "n", "at", band)
    # lists with more than one member; the others link nothing
    shared = posted.groupBy("token").agg(F.count("*").alias("m")).filter("m > 1").select("token")
    lists = materialize(posted.join(shared, "token"), "lists")
    rows = full.groupBy("doc_id").agg((F.count("*") > 1).alias("several"))
    # the hub of a list is the member that has the fewest rarer tokens before this one: the likeliest centre of a group
    hubs = lists.groupBy("token", "band").agg(F.min(F.struct("at", "n", "node")).alias("hub"), F.count("*").alias("m")).filter("m > 1")
    hubs = hubs.select("token", "band", F.col("hub.node").alias("a"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"))
    can = F.least(F.col("n") - F.col("at"), F.col("hub_n") - F.col("hub_at")) >= F.ceil((F.col("n") + F.col("hub_n")) * percent / (100 + percent))
    stars = lists.join(hubs, ["token", "band"]).filter((F.col("a") != F.col("node")) & can).select("a", F.col("node").alias("b")).distinct()
    first = materialize(verify(materialize(possible(stars, classes, percent), "pairs"), text, rows, k, percent), "found")
    # rows of one doc_id are one document
    same_id = full.groupBy("key").agg(F.min("doc_id").alias("a")).join(full.select("key", F.col("doc_id").alias("b")).distinct(), "key").filter("a != b").select("a", "b")
    groups = connected_components(first)
    placed = lists.join(groups, "node", "left").select("token", "node", "n", "at", F.coalesce("component", "node").alias("component"))
    mixed = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("token")
    rest = materialize(placed.join(mixed, "token"), "rest")
    x, y = rest.alias("x"), rest.alias("y")
    overlap = F.ceil((F.col("x.n") + F.col("y.n")) * percent / (100 + percent))
    room = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    open_pairs = (
        x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & (F.struct("x.n", "x.node") < F.struct("y.n", "y.node"))
               & (F.col("x.n") * 100 >= F.col("y.n") * percent) & (room >= overlap))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()
    )
    # between components one link is as good as many
    place = placed.select("node", "component").distinct()
    ends = verify(materialize(possible(open_pairs, classes, percent), "pairs"), text, rows, k, percent).join(place.toDF("a", "ca"), "a").join(place.toDF("b", "cb"), "b")
    second = materialize(ends.select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "found")
    groups = connected_components(first.unionAll(second).unionAll(same_id))
    ids = signed.select("doc_id", F.col("n").alias("n_shingles"))
    return ids.join(groups.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents"), k=4, percent=85)
