"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), spread over the cluster.

A document is the set of its distinct word shingles, as 64-bit hashes. Two sets can only link if they
share many elements, so the join looks for sets that occur often enough in each other's inverted lists.

1. Documents with the same set become one class; its smallest id represents it from then on.
2. Each set puts its smallest ``n - ceil(t n) + l`` hashes (``l = 1 + n // SLACK``) into inverted
   lists. Linked sets share at least ``l`` of them (of the smaller of the two ``l``).
3. Lists are divided: short ones (at most ``SHORT`` sets) are merged into counts a pair, and a pair
   stays when its count reaches ``l`` less the long lists either set is in. Long lists are skipped;
   only sets with at least ``l`` long lists could meet in nothing else, and long lists tie those
   together. Connected pairs and ties are candidate groups: no link leaves a group.
   Short sets that share common lines are tied without a link, and their group grows with the table. A
   group of more than ``FINER`` shingles is therefore divided again by step 3, with lists of the elements
   that fewest of its sets hold, taken from the whole sets.
4. A group's texts go to one task, which runs DivideSkip over the whole sets: short lists are merged,
   sets that occur at least ``T - L`` times are probed in the ``L`` longest lists by binary search, and
   the exact overlap decides. It searches breadth first and only among sets not reached yet, so a
   group of copies costs about one search, not all pairs.
5. A group of more than ``BLOCK`` shingles is cut into blocks that share two of its members; what does
   not end up in the largest cluster is then searched for in every block.

No list, pair or candidate is dropped for its length. Lists are merged by sorting and counting; the
skipped ones are probed by binary search.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lower-cased. With fewer words than a shingle the
whole sequence is one shingle. A null text or one without words has no shingles and links with nothing;
its component is its own id. Rows without id link like others but never name a component. Repeated
rows get the same answer; an id that repeats with different texts is as many documents, each with its
own set, which may give their components the same name. Ids are longs (others are cast). Long texts
are hashed whole. An empty table gives no rows. Columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_batch, components, cut, drop_table, release, table
from .registry import query

WORDS, PERCENT = 4, 85
SLACK = 20
SHORT = 32
FINER = 1 << 18
BLOCK = 1 << 21
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 4096
_POWERS = np.cumprod(np.full(_LONG_WORD + 1, _MULTIPLY, dtype=np.uint64))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    length = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    if length.max(initial=0) >= _LONG_WORD:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    letters = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    first = np.cumsum(np.append(0, length[:-1] + 1))
    inside = np.arange(len(letters)) - np.repeat(first, length + 1)
    letters[first + length] = 0
    return _mix(np.add.reduceat(letters * _POWERS[inside], first, dtype=np.uint64))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text."""
    found = (text or "").encode().lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    # Words of any length hash the same way whatever their neighbours are.
    plain = [w for w in found if len(w) < _LONG_WORD]
    h = word_hashes(plain) if len(plain) == len(found) else np.concatenate([word_hashes([w]) for w in found])
    size = min(words, len(h))
    total = np.zeros(len(h) - size + 1, dtype=np.uint64)
    for k in range(size):
        total = total * _MULTIPLY + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(total + np.uint64(size)))


def least_overlap(n, percent: int = PERCENT):
    """Elements that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def slack(n: int) -> int:
    """Shared hashes that are asked of a set of n beyond the first."""
    return 1 + n // SLACK


def slack_column(n):
    return (F.lit(1) + F.floor(n / SLACK)).cast("long")


def text_tag(text: Column) -> Column:
    """Tells rows apart that repeat an id with different texts."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def shingle_sets(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, tag, n, key, prefix): size, digest and indexed part of every document's set."""

    def fn(batch):
        sets = [shingle_set(t, words) for t in batch.column(2).to_pylist()]
        n = np.array([len(s) for s in sets], dtype=np.int64)
        prefix = [s[: len(s) - least_overlap(len(s), percent) + slack(len(s))].view(np.int64) for s in sets]
        ends = np.append(0, np.cumsum([len(p) for p in prefix])).astype(np.int32)
        keys = pa.array(list(map(set_key, sets)), pa.binary())
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix)))
        return pa.record_batch([batch.column(0), batch.column(1), pa.array(n), keys, lists], ["doc_id", "tag", "n", "key", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col("text")).alias("tag"), "text")
    return by_batch(rows, fn, "doc_id long, tag long, n long, key binary, prefix array<long>")


def set_key(elements: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(elements.tobytes())


def hot_tokens(sets: DataFrame, local: int = 16, limit: int = 100_000) -> DataFrame:
    """(token): the most common elements of sets, counted inside batches; a report, the join does not
    depend on it."""

    def fn(batch):
        tokens, n = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
        often = n >= local
        return pa.record_batch([pa.array(tokens[often]), pa.array(n[often])], ["token", "n"])

    found = by_batch(sets.select("prefix"), fn, "token long, n long")
    return found.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(limit).select("token")


def candidate_edges(sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Edges (a, b) whose components hold every link between the sets (id, n, prefix)."""
    posts = sets.select(F.explode("prefix").alias("token"), "id", "n")
    # Lengths are counted before the shuffle; each posting then finds the length of its list.
    lengths = posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    lists = cut(posts.join(lengths, "token", "left").where("m IS NOT NULL").select("token", "id", "n", "m"), "lists")
    long_lists = lists.where(F.col("m") > SHORT).groupBy("id").agg(
        F.count("*").alias("longs"), F.first("n").alias("n"), F.max_by("token", F.struct("m", "token")).alias("main"), F.collect_list("token").alias("tokens")
    )
    long_lists = cut(long_lists, "longs")
    release(sets.sparkSession)
    longs = long_lists.select("id", "longs")
    # Short lists: at most SHORT sets each, merged into counts a pair.
    short = lists.where(F.col("m") <= SHORT).groupBy("token").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("own"))
    pairs = short.select(F.explode(F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x.alias("x"), y.alias("y")))))).alias("p"))
    fits = 100 * F.least("p.x.n", "p.y.n") >= percent * F.greatest("p.x.n", "p.y.n")
    counted = pairs.where(fits).groupBy(F.col("p.x.id").alias("a"), F.col("p.y.id").alias("b")).agg(
        F.count("*").alias("c"), F.min(slack_column(F.least("p.x.n", "p.y.n"))).alias("need")
    )
    la, lb = longs.select(F.col("id").alias("a"), F.col("longs").alias("la")), longs.select(F.col("id").alias("b"), F.col("longs").alias("lb"))
    enough = F.col("c") >= F.col("need") - F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    met = counted.join(la, "a", "left").join(lb, "b", "left").where(enough).select("a", "b")
    return met.unionByName(ties(long_lists, percent))


def ties(long_lists: DataFrame, percent: int) -> DataFrame:
    """Edges that connect all sets which are in one long list, among the sets with enough long lists to
    meet in nothing else. ``long_lists``: a row a set (id, n, longs, main, tokens).

    A set is tied to the smallest set with its ``main`` token, the longest of its lists; those heads are
    tied by every token that stands beside different main ones. A family of copies has few main tokens,
    so its many equal (main, token) pairs shrink to a few before anything is joined.
    """
    least = slack_column(F.ceil(F.col("n") * percent / 100))
    deep = long_lists.where(F.col("longs") >= F.least(least, slack_column(F.col("n"))))
    heads = cut(deep.groupBy("main").agg(F.min("id").alias("head")), "heads")
    own = deep.select("id", "main").join(heads, "main").where("head < id").select(F.col("head").alias("a"), F.col("id").alias("b"))
    beside = cut(deep.select("main", F.explode("tokens").alias("token")).distinct(), "beside")
    # A token with one main token ties nothing.
    shared = beside.join(beside.groupBy("token").agg(F.count("*").alias("k")).where("k > 1").select("token"), "token", "left_semi")
    met = cut(shared.join(heads, "main").select("token", "head").distinct(), "met")
    first = met.groupBy("token").agg(F.min("head").alias("a"))
    across = met.join(first, "token").where("a < head").select("a", F.col("head").alias("b")).distinct()
    return own.unionByName(across)


def search(ids: np.ndarray, sets: list[np.ndarray], percent: int = PERCENT, queries: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges (root, id) of clusters of linked sets, by breadth-first DivideSkip searches.

    With ``queries`` (a mask) only links of those sets are looked for, each among all others.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    tokens, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.append(0, np.cumsum(size))
    own = [flat[ends[k] : ends[k + 1]] for k in range(len(sets))]

    def index(docs: np.ndarray):
        """Inverted lists of the sets ``docs``: by token, its sets."""
        token = np.concatenate([own[k] for k in docs])
        order = np.argsort(token, kind="stable")
        starts = np.searchsorted(token[order], np.arange(len(tokens) + 1))
        return starts, np.repeat(docs, size[docs])[order]

    def occurring(k: int, starts: np.ndarray, members: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The wanted sets that link to set k."""
        mine = own[k]
        length = starts[mine + 1] - starts[mine]
        mine, length = mine[length > 0], length[length > 0]
        least = int(least_overlap(size[k], percent))
        if len(mine) < least:
            return np.zeros(0, dtype=np.int64)
        skip = min(len(mine), int(least / (0.05 * np.log2(max(2, length.max())) + 1)), least - 1)
        order = np.argsort(length, kind="stable")
        short, probed = mine[order[: len(mine) - skip]], mine[order[len(mine) - skip :]]
        length = starts[short + 1] - starts[short]
        merged = members[np.repeat(starts[short] - np.cumsum(length) + length, length) + np.arange(length.sum())]
        found, count = np.unique(merged[wanted[merged]], return_counts=True)
        found, overlap = found[count >= least - skip], count[count >= least - skip]
        for t in probed if len(found) else ():
            row = members[starts[t] : starts[t + 1]]
            at = np.searchsorted(row, found)
            at[at == len(row)] = 0
            overlap = overlap + (row[at] == found)
        return found[(100 * overlap >= percent * (size[k] + size[found] - overlap)) & (found != k)]

    out: list[tuple[int, int]] = []
    if queries is not None:
        starts, members = index(np.arange(len(sets)))
        everyone = np.ones(len(sets), dtype=bool)
        for k in np.flatnonzero(queries):
            out += [(int(min(ids[k], ids[j])), int(max(ids[k], ids[j]))) for j in occurring(k, starts, members, everyone)]
        return out
    left = size > 0
    indexed = np.flatnonzero(left)
    starts, members = index(indexed) if len(indexed) else (None, None)
    for seed in np.argsort(ids, kind="stable"):
        if not left[seed]:
            continue
        left[seed] = False
        queue = deque([int(seed)])
        while queue:
            if left.sum() * 2 < len(indexed):
                indexed = np.flatnonzero(left)
                if not len(indexed):
                    break
                starts, members = index(indexed)
            for j in occurring(queue.popleft(), starts, members, left):
                left[j] = False
                queue.append(int(j))
                out.append((int(ids[seed]), int(ids[j])))
        if not left.any():
            break
    return out


def _search_groups(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges found inside each (component, block); rows: component, block, node, key, text, asked. Of the
    rows of a node one counts whose text has the node's set: ids may repeat with other texts."""

    def fn(got: pa.Table) -> pa.Table:
        nodes, sets, asked = [], [], []
        seen = set()
        for node, key, text, asks in zip(*(got.column(c).to_pylist() for c in ("node", "key", "text", "asked"))):
            own = shingle_set(text, words) if node not in seen else None
            if own is not None and set_key(own) == key:
                seen.add(node)
                nodes.append(node)
                sets.append(own)
                asked.append(asks)
        if not nodes:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        asked = np.array(asked, dtype=bool)
        edges = search(np.array(nodes, dtype=np.int64), sets, percent, asked if asked.any() else None)
        return pa.table({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return rows.groupBy("component", "block").applyInArrow(fn, "a long, b long")


def finer_edges(texts: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges like those of :func:`candidate_edges` between the sets of each component (component, node, key, text).

    What holds for the smallest hashes of two linked sets holds in any order of the elements. Here the ones that
    fewest sets of the component hold come first, so a line that many sets share counts only in sets that have
    little else. Elements that no other set holds take their places in the order but need no list.
    """

    def fn(batch):
        ids, sets = [], []
        for node, component, key, text in zip(*(batch.column(c).to_pylist() for c in ("node", "component", "key", "text"))):
            own = shingle_set(text, words)
            if set_key(own) == key:
                ids.append(node)
                # Components share no elements.
                sets.append(_mix(own ^ _mix(np.array([component], dtype=np.int64).view(np.uint64))).view(np.int64))
        ends = np.append(0, np.cumsum([len(s) for s in sets])).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, dtype=np.int64), *sets])))
        return pa.record_batch([pa.array(ids, pa.int64()), lists], ["id", "tokens"])

    whole = by_batch(texts.select("node", "component", "key", "text"), fn, "id long, tokens array<long>")
    whole = cut(whole.groupBy("id").agg(F.first("tokens").alias("tokens")), "whole")
    posts = whole.select("id", F.size("tokens").cast("long").alias("n"), F.explode("tokens").alias("token"))
    lengths = posts.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    shared = posts.join(lengths, "token").groupBy("id").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("m", "token"))).alias("shared"))
    # As many places as in the prefix of shingle_sets.
    places = F.col("n") - F.ceil(F.col("n") * percent / 100) + slack_column(F.col("n")) - (F.col("n") - F.size("shared"))
    listed = F.transform(F.slice("shared", F.lit(1), F.col("places").cast("int")), lambda x: x["token"])
    sets = cut(shared.withColumn("places", places).where("places > 0").select("id", "n", listed.alias("prefix")), "rare")
    drop_table(whole)
    return candidate_edges(sets, percent)


def place(groups: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Groups (node, component) with what finds a node's text, shingles of the component, and the blocks a node is in."""
    sized = groups.join(sets.select(F.col("id").alias("node"), "doc_id", "tag", "key", "n"), "node")
    totals = sized.groupBy("component").agg(
        F.sum("n").alias("total"), F.min_by("node", F.xxhash64("node")).alias("first"), F.max_by("node", F.xxhash64("node")).alias("last")
    )
    # A table of its own: the join's exchange is then its own too, and a large component can be split.
    totals = cut(totals, "totals")
    release(sets.sparkSession)
    blocks = F.ceil(F.col("total") / F.lit(block)).cast("int")
    shared = F.col("node").isin(F.col("first"), F.col("last")) & (blocks > 1)
    own = F.when(shared, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.pmod(F.xxhash64("node"), blocks).cast("int")))
    return cut(sized.join(totals, "component").select("node", "component", "total", "key", F.col("doc_id").alias("of"), F.col("tag").alias("text_tag"), blocks.alias("blocks"), own.alias("own")), "placed")


def link_components(docs: DataFrame, sets: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(node, component) of every class of sets (id, doc_id, tag, key, n, prefix) that links with another
    one; ``id`` numbers the classes, ``doc_id`` and ``tag`` say which document stands for it."""
    placed = place(components(candidate_edges(sets, percent)), sets, block)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_tag(F.col("text")).alias("tag"), "text")
    texts = rows.join(placed, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("tag") == F.col("text_tag"))).drop("of", "doc_id", "tag", "text_tag")
    texts = cut(texts, "texts")
    wide = texts.where(F.col("total") > FINER)
    divide = not wide.isEmpty()
    release(docs.sparkSession)
    if divide:
        again = place(components(finer_edges(wide, words, percent)), sets, block).drop("key", "of", "text_tag")
        divided = cut(texts.where(F.col("total") <= FINER).unionByName(wide.select("node", "key", "text").join(again, "node")), "texts")
        drop_table(texts)
        texts = divided
    inside = texts.select("component", F.explode("own").alias("block"), "node", "key", "text", F.lit(False).alias("asked"))
    edges = cut(_search_groups(inside, words, percent), "links")
    large = texts.where("blocks > 1")
    if not large.isEmpty():
        found = components(edges)
        of = large.join(found.select("node", F.col("component").alias("cluster")), "node", "left").withColumn("cluster", F.coalesce("cluster", "node"))
        of = cut(of, "clusters")
        counts = of.groupBy("component", "cluster").agg(F.count("*").alias("n")).groupBy("component").agg(F.max_by("cluster", F.struct("n", "cluster")).alias("main"))
        rest = of.join(counts, "component").where("cluster <> main").drop("main")
        # Every set outside the main cluster asks in every block; askers come in blocks of their own.
        asking = rest.select("component", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), F.col("own")[0].alias("q"), "node", "key", "text", F.lit(True).alias("asked"))
        wanted = asking.select("component", "b", "q").distinct()
        asked = of.select("component", F.explode("own").alias("b"), "node", "key", "text", F.lit(False).alias("asked")).join(wanted, ["component", "b"])
        both = asking.unionByName(asked).groupBy("component", "b", "q", "node", "key", "text").agg(F.bool_or("asked").alias("asked"))
        edges = cut(edges.unionByName(_search_groups(both.withColumn("block", F.concat_ws(":", "b", "q")), words, percent)), "links")
    return components(edges)


def ngram_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id, tag, set_key, leads) for every row: the smallest id
    reachable by links, the smallest id with exactly the same set, hashes of text and set, and whether the row stands
    for its component: it has that smallest id, and of several sets of that id the first one. Rows that
    repeat id and text lead together; a row without shingles leads itself."""
    full = cut(shingle_sets(docs, words, percent), "sets")
    narrow = cut(full.select("doc_id", "tag", "n", "key"), "keys")
    # Each class of equal sets has a number and a row that stands for it, with an id if any has one.
    rep = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tag")).alias("rep")
    classes = narrow.where("n > 0").groupBy("key").agg(rep).select("key", F.col("rep.doc_id").alias("first"), F.col("rep.tag").alias("text"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()), "numbers")
    reps = classes.select("first", "text", F.col("key").alias("own"), "id")
    picked = full.join(reps, F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tag") == F.col("text"))).where("key = own")
    picked = picked.groupBy("id").agg(*(F.first(c).alias(c) for c in ("doc_id", "tag", "key", "n", "prefix")))
    sets = cut(picked, "classes")
    drop_table(full)
    linked = cut(link_components(docs, sets, words, percent, block), "linked")
    of = classes.join(linked.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    of = cut(of, "components")
    heads = of.groupBy("component").agg(F.min(F.struct(F.col("first").isNull(), "first", "key")).alias("head"))
    named = cut(of.join(heads, "component").select("key", "first", F.col("head.first").alias("name"), (F.col("head.key") == F.col("key")).alias("main")), "named")
    some = narrow.where("n > 0").join(named, "key").select("doc_id", "n", "name", "first", "tag", "key", (F.col("main") & F.col("doc_id").eqNullSafe(F.col("name"))).alias("leads"))
    none = narrow.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("name"), F.col("doc_id").alias("first"), "tag", F.lit(None).cast("binary").alias("key"), F.lit(True).alias("leads"))
    return some.unionByName(none).select("doc_id", F.col("n").alias("n_shingles"), F.col("name").alias("component_id"), F.col("first").alias("class_id"), "tag", F.col("key").alias("set_key"), "leads")


@query("op1_ngram_join")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")
