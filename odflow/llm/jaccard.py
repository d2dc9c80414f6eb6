"""Components of documents by Jaccard similarity of word n-grams, with a token-group matrix.

A document's set holds its distinct shingles (runs of five words, A-Z lower-cased), as 64-bit hashes. Documents with equal sets are one class.

1. Classes are partitioned into groups of likely similar ones by a token that similar sets tend to share: the least hash among their
   frequent shingles where those reach into the prefix (below), else the least of all. Each group is opened for its leader, the set with the
   largest share of frequent shingles: what reaches half of the leader's similarity (``LOOSE``) stays in its group, so that a family of near
   copies is one group even where its members do not link; all others become groups of their own. Leaders and the others are grouped
   again by further hashes.
2. Members that no chain of links ties to their leader ask their own group: its token union first, then its members.
3. Token-group matrix: each set's rarest tokens (a prefix long enough that a similar set's prefix shares ``1 + n // 10`` of them)
   are stored once per group. Tokens meet; two groups whose unions share fewer tokens than any of their members would need are out.
4. Groups that are left as pairs are opened for single queries: a query meets the union of a group's tokens first, and its members only where the
   overlap with the union reaches what similarity asks for. The query is the smaller group's leader; then, unless both groups
   lie in one component, all members of the smaller. Large groups are opened in parts; queries go to each part. A part gives a spanning
   forest of its links, never more rows than members and queries.
5. Links run together into components by rounds of least neighbours.

Every link between different sets is found or lies inside a component already; which documents are frequent or grouped only steers the cost.

Cases: fewer words than a shingle form one shingle; a text without words (or null) has an empty set and links with nothing; repeated rows and
equal texts are one class; rows of one id may stand in different components; a null id is no candidate for the smallest id. Other columns
are ignored by ``components``. An empty table gives no rows.
Bound: ``MOST_FREQUENT`` shingles are broadcast, the most frequent ones; others are ordered by hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from odflow.llm import tables, text

SHINGLE = 5
PERCENT = 80
#: Similarity with its leader that keeps a set in a group.
LOOSE = 50
#: One grouping after the other, by hashes of these salts.
GROUPINGS = {"grp": 0, "grp2": 11, "grp3": 23}
CHUNK_BYTES = 8 << 20
#: Text whose prefixes, or sets, a task holds at once; a dozen arrays of its words stand beside it.
DEAL_BYTES = 2 << 20
SLICE_BYTES = 1 << 20
#: A shingle is frequent if parts of the corpus that hold it twice or more count it this often in all.
FREQUENT = 32
MOST_FREQUENT = 1 << 20
#: Members of a part of a group.
PART_ROWS = 1024
#: Buckets of group parts per shuffle partition.
VERIFY_BUCKETS = 8
#: Rows of a key table that may be broadcast.
BROADCAST_ROWS = 500_000
#: Groups in which a token of the prefixes makes it frequent too.
CROWDED = 16
_KEPT = np.uint64((1 << 48) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(column: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, and where each row's begin (one entry more than rows)."""
    data, offsets = text.flat(column)
    data = _LOWER[data]
    starts, ends, first = text.words(data, offsets)
    words = text.span_hashes(text.prefix_hashes(data), starts, ends)
    prefix = text.prefix_hashes(words)
    size = np.diff(first)
    count = np.where(size == 0, 0, np.maximum(size - n + 1, 1))
    begin = text.ranges(first[:-1], count)
    codes = text.span_hashes(prefix, begin, begin + np.repeat(np.minimum(size, n), count))
    upto = np.concatenate(([0], np.cumsum(count)))
    sets = [np.unique(codes[a:b]) for a, b in zip(upto[:-1], upto[1:], strict=True)]
    lengths = np.array([len(s) for s in sets], dtype=np.int64)
    return (np.concatenate(sets) if sets else codes), np.concatenate(([0], np.cumsum(lengths)))


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = CHUNK_BYTES) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
    """Sets of many rows at a time, with other columns of the rows."""
    held, size = [], 0
    for batch in text.slices(batches, "text", SLICE_BYTES):
        held.append(([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], *shingle_sets(batch.column("text"))))
        size += batch.column("text").nbytes
        if size > limit:
            glued = [_glued(held, len(columns))]
            held, size = [], 0
            yield glued.pop()
    if held:
        yield _glued(held, len(columns))


def _glued(held: list, n: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    lengths = np.concatenate([np.diff(u) for _, _, u in held])
    return [np.concatenate([c[k] for c, _, _ in held]) for k in range(n)], np.concatenate([t for _, t, _ in held]), np.concatenate(([0], np.cumsum(lengths)))


def _frequent(own: DataFrame, most: int) -> np.ndarray:
    """Hashes of frequent shingles, sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tokens, _ in _chunks(batches, []):
            token, times = np.unique(tokens, return_counts=True)
            some = times >= 2
            yield pa.RecordBatch.from_arrays([pa.array(token[some].view(np.int64)), pa.array(times[some])], ["token", "n"])

    counts = own.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counts.where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "token").limit(most).select("token").toArrow()
    return np.unique(top.column("token").to_numpy().astype(np.int64).view(np.uint64) & _KEPT)


def _describe(frequent):
    """Per document: set size, signature, group keys, and the share of frequent shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (row_key,), tokens, upto in _chunks(batches, ["row_key"], DEAL_BYTES):
            size = np.diff(upto)
            full = size > 0
            at = upto[:-1][full]
            marks = [np.zeros(len(row_key), dtype=np.uint64) for _ in range(2 + len(GROUPINGS))]
            share = np.zeros(len(row_key))
            if len(at):
                often = _among(frequent.value, tokens)
                marks[0][full] = np.add.reduceat(text.mix64(tokens), at)
                marks[1][full] = np.bitwise_xor.reduceat(text.mix64(tokens + np.uint64(7)), at)
                share[full] = np.add.reduceat(often.astype(np.int64), at) / size[full]
                out = np.repeat(10 * share[full] >= 7, size[full]) & ~often
                for mark, salt in zip(marks[2:], GROUPINGS.values(), strict=True):
                    stirred = text.mix64(tokens + np.uint64(salt))
                    stirred[out] = np.uint64(0xFFFFFFFFFFFFFFFF)
                    mark[full] = np.minimum.reduceat(stirred, at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(row_key), pa.array(size), *[pa.array(m.view(np.int64)) for m in marks], pa.array(share)], ["row_key", "n", "sum", "mix", *GROUPINGS, "share"]
            )

    return run


def _among(common: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Which tokens are among the frequent ones, of which 48 bits are kept."""
    if not len(common):
        return np.zeros(len(tokens), dtype=bool)
    tokens = tokens & _KEPT
    return common[np.minimum(np.searchsorted(common, tokens), len(common) - 1)] == tokens


def _prefixes(frequent, buckets: int, percent: int):
    """The token-group matrix, packed per bucket of tokens: prefixes of sets, rare tokens first, then frequent ones, each by hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (group,), tokens, upto in _chunks(batches, ["grp"], DEAL_BYTES):
            size = np.diff(upto)
            need = 1 + size // 10
            length = np.where(size > 0, size - -(-percent * size // 100) + need, 0)
            row = np.repeat(np.arange(len(group), dtype=np.int64), size)
            order = np.argsort(2 * row + _among(frequent.value, tokens), kind="stable")
            token = tokens[order[text.ranges(upto[:-1], length)]]
            del order, row
            owner = np.repeat(np.arange(len(group)), length)
            out: dict[str, list] = {k: [] for k in _NAMES}
            bucket = (token >> np.uint64(44)).astype(np.int64) % buckets
            by = np.argsort(bucket, kind="stable")
            for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
                if not len(part):
                    continue
                groups, local = np.unique(group[owner[part]], return_inverse=True)
                sizes = size[owner[part]]
                least, most = np.full(len(groups), 1 << 30, dtype=np.int64), np.zeros(len(groups), dtype=np.int64)
                np.minimum.at(least, local, sizes)
                np.maximum.at(most, local, sizes)
                # 48 bits tell tokens of a bucket apart.
                cells = (groups, least.astype(np.uint32), most.astype(np.uint32), token[part].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6], local.astype(np.uint32))
                for name, value in zip(_NAMES, (int(bucket[part[0]]), *map(text.tight, cells)), strict=True):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[n], t) for n, t in zip(_NAMES, _TYPES, strict=True)], _NAMES)

    return run


_NAMES = ["bucket", "groups", "least", "most", "token", "owner"]
_TYPES = [pa.int64(), *[pa.binary()] * 5]
_SHAPE = "bucket long, groups binary, least binary, most binary, token binary, owner binary"


def _lists(sent: pa.Table) -> tuple[np.ndarray, ...]:
    """Groups of a bucket of tokens, their smallest and largest sets there, and each shared token's groups.

    Tokens and groups' numbers come sorted, each pair once, with the size of every token's list.
    """
    read = lambda name, dtype: [text.untight(v.as_buffer(), dtype) for v in sent.column(name)]
    groups = read("groups", np.int64)
    shift = np.cumsum([0, *[len(g) for g in groups]])
    group = np.concatenate(groups)
    packed = np.concatenate(read("token", np.uint8)).reshape(-1, 6)
    wide = np.zeros((len(packed), 8), dtype=np.uint8)
    wide[:, :6] = packed
    token = wide.view("<u8").ravel()
    owner = np.concatenate([o.astype(np.int64) + s for o, s in zip(read("owner", np.uint32), shift, strict=False)])
    ids, number = np.unique(group, return_inverse=True)
    least, most = np.full(len(ids), 1 << 30, dtype=np.int64), np.zeros(len(ids), dtype=np.int64)
    np.minimum.at(least, number, np.concatenate(read("least", np.uint32)).astype(np.int64))
    np.maximum.at(most, number, np.concatenate(read("most", np.uint32)).astype(np.int64))
    by = np.argsort(token, kind="stable")
    token, owner = token[by], number[owner[by]]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
    size = np.diff(np.concatenate((begin, [len(token)])))
    shared = np.repeat(size > 1, size)
    token, owner = token[shared], owner[shared]
    by = np.lexsort((owner, token))
    token, owner = token[by], owner[by]
    new = np.ones(len(token), dtype=bool)
    new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
    token, owner = token[new], owner[new]
    begin = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))) if len(token) else np.zeros(0, np.int64)
    return ids, least, most, token, owner, np.diff(np.concatenate((begin, [len(token)])))


def _crowded(sent: pa.Table) -> pa.Table:
    """Tokens that stand in the prefixes of many groups."""
    _, _, _, token, _, size = _lists(sent)
    first = np.cumsum(size) - size
    many = size >= CROWDED
    return pa.table({"token": token[first[many]].view(np.int64), "n": size[many].astype(np.int64)})


def _meet(percent: int):
    """Pairs of groups that share tokens of one bucket: how many, and the fewest that similar members could share.

    Groups whose sets differ too much in size are no pair.
    """
    return lambda sent: _met(sent, percent)


def _met(sent: pa.Table, percent: int) -> pa.Table:
    ids, least, most, token, owner, size = _lists(sent)
    # Each entry with all later ones of its token, a bounded number of pairs at a time.
    place = text.ranges(np.zeros(len(size), np.int64), size)
    after = np.repeat(size, size) - place - 1
    seen, count = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    cuts = np.searchsorted(np.cumsum(after), np.arange(0, int(after.sum()) + 1, 4_000_000), side="left")
    for low, high in zip(cuts, [*cuts[1:], len(after)], strict=True):
        if high <= low:
            continue
        first = np.repeat(np.arange(low, high), after[low:high])
        second = text.ranges(np.arange(low, high) + 1, after[low:high])
        a, b = owner[first], owner[second]
        alike = (100 * most[a] >= percent * least[b]) & (100 * most[b] >= percent * least[a])
        code = a[alike].astype(np.uint64) << np.uint64(32) | b[alike].astype(np.uint64)
        code, inverse = np.unique(np.concatenate((seen, code)), return_inverse=True)
        count = np.bincount(inverse, weights=np.concatenate((count, np.ones(len(inverse) - len(count), np.int64)))).astype(np.int64)
        seen = code
    a, b = (seen >> np.uint64(32)).astype(np.int64), (seen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return pa.table({"a": ids[a], "b": ids[b], "shared": count, "least": 1 + np.minimum(least[a], least[b]) // 10})


def _verify(percent: int, loose: int | None):
    """Links of queries with members of the group part they name: the union of tokens first, then the members.

    A part's links are thinned to a spanning forest. With ``loose`` every member of that similarity is given instead, and whether it is a link.
    """
    least = percent if loose is None else loose

    def one(key: np.ndarray, is_query: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[int, int, bool]]:
        members, queries = np.flatnonzero(is_query == 0), np.flatnonzero(is_query == 1)
        if not len(members) or not len(queries):
            return
        size = np.array([len(sets[i]) for i in members])
        owner = np.repeat(np.arange(len(members)), size)
        tokens = np.concatenate([sets[i] for i in members])
        by = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[by], owner[by]
        union, begin = np.unique(tokens, return_index=True)
        end = np.concatenate((begin[1:], [len(tokens)]))
        tree = np.arange(len(members))  # the same number for members that links of this part tie together
        for q in queries:
            mine = sets[q]
            at = np.minimum(np.searchsorted(union, mine), len(union) - 1)
            at = at[union[at] == mine]
            if 100 * len(at) < least * len(mine):
                continue
            both = np.bincount(owner[text.ranges(begin[at], end[at] - begin[at])], minlength=len(members))
            either = size + len(mine) - both
            itself = key[members] == key[q]
            near = np.flatnonzero((100 * both >= least * either) & ~itself)
            if loose is not None:
                yield from ((int(key[q]), int(key[members[m]]), bool(100 * both[m] >= percent * either[m])) for m in near)
                continue
            trees, first = np.unique(tree[near], return_index=True)
            own = tree[itself]
            yield from ((int(key[q]), int(key[members[near[m]]]), True) for t, m in zip(trees, first, strict=True) if t not in own)
            joined = np.concatenate((trees, own))
            if len(joined) > 1:
                tree[np.isin(tree, joined)] = joined[0]

    def run(rows: pa.Table) -> pa.Table:
        columns = [rows.column(c).to_numpy() for c in ("grp", "part", "is_query", "row_key")]
        _, once = np.unique(np.stack(columns, axis=1), axis=0, return_index=True)  # sorted by group, part and side
        grp, part, is_query, key = (c[once] for c in columns)
        rows = rows.take(pa.array(once))
        cuts = np.flatnonzero((grp[1:] != grp[:-1]) | (part[1:] != part[:-1])) + 1
        links: list[tuple[int, int, bool]] = []
        for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(once)], strict=True):
            parts = [shingle_sets(b.column("text")) for b in text.slices(rows.slice(low, high - low).to_batches(), "text", SLICE_BYTES)]
            sets = [t[u[i] : u[i + 1]] for t, u in parts for i in range(len(u) - 1)]
            links += one(key[low:high], is_query[low:high], sets)
        a, b, link = zip(*links, strict=True) if links else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "link": pa.array(link, pa.bool_())})

    return run


def _small(frame: DataFrame) -> DataFrame:
    """Marked for broadcast if it is small by count; else joined by shuffle."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def _open(own: DataFrame, members: DataFrame, queries: DataFrame, percent: int, loose: int | None = None) -> DataFrame:
    """Links ``a, b, link`` of ``queries`` (``row_key, grp``) with members (``row_key, grp, parts``) of the group they name."""
    from odflow.session import write_table

    wanted = queries.select("grp").distinct()
    target = members.join(wanted, "grp").select("row_key", "grp", F.pmod(F.xxhash64("row_key"), "parts").alias("part"), F.lit(0).alias("is_query"))
    parts = members.groupBy("grp").agg(F.first("parts").alias("parts"))
    asked = queries.join(parts, "grp").select("row_key", "grp", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.lit(1).alias("is_query"))
    needed = write_table(target.unionByName(asked))
    rows = own.join(_small(needed), "row_key").select("grp", "part", "row_key", "is_query", "text")
    # Many small groups share a bucket; a part of a large one stays whole in its own.
    buckets = F.lit(VERIFY_BUCKETS * tables.width(own.sparkSession))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("grp", "part"), buckets))
    return write_table(dealt.groupBy("bucket").applyInArrow(text.tidy(_verify(percent, loose)), "a long, b long, link boolean"))


def _sized(members: DataFrame) -> DataFrame:
    """``row_key, grp, share`` with the group's ``rows``, ``leader`` (most frequent shingles) and number of ``parts``."""
    from odflow.session import write_table

    best = F.max(F.struct("share", "row_key"))["row_key"]
    size = members.groupBy("grp").agg(F.count("*").alias("rows"), best.alias("leader"))
    return write_table(members.join(size.withColumn("parts", F.ceil(F.col("rows") / PART_ROWS).cast("long")), "grp"))


def connected(links: DataFrame) -> DataFrame:
    """``node, root``: every node of ``links`` (``a, b``) with its component's least node."""
    from odflow.session import materialise

    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # Least neighbours of both sides, then of the smaller side only.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        small = small.unionByName(least.select("u", F.col("m").alias("v")))
        new = materialise(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        if not new.exceptAll(edges).take(1) and not edges.exceptAll(new).take(1):
            break
        edges = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, row_key, n_shingles, component_id, root`` for every row.

    ``row_key`` is equal for equal ids and texts; ``root`` is one of a component's keys, equal for all its rows.
    """
    from odflow.session import write_table

    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("row_key", F.xxhash64("doc_id", "text"))
    frequent = spark.sparkContext.broadcast(_frequent(own, MOST_FREQUENT))
    keys = ", ".join(f"{k} long" for k in GROUPINGS)
    described = write_table(own.select("row_key", "text").mapInArrow(_describe(frequent), f"row_key long, n long, sum long, mix long, {keys}, share double"))
    ids = own.select("row_key", "doc_id").join(described.distinct(), "row_key")
    same, further = ["sum", "mix", "n", "grp"], [k for k in GROUPINGS if k != "grp"]
    classes = write_table(ids.where("n > 0").groupBy(*same).agg(F.min("row_key").alias("class"), F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in further], F.first("share").alias("share")))

    # First groups, and what is like their leaders; then what is left, and the leaders, again by the other keys.
    clusters = classes.select(*same, F.col("class").alias("row_key"), *further, "share", F.col("class").alias("cluster"))
    stars = None
    for key in GROUPINGS:
        first = _sized(clusters.where("row_key = cluster").select("row_key", F.col(key).alias("grp"), "share"))
        leaders = first.where("rows > 1").select(F.col("leader").alias("row_key"), "grp").distinct()
        found = _open(own, first, leaders, percent, LOOSE)
        stars = found if stars is None else stars.unionByName(found)
        starred = found.select(F.col("a").alias("_to"), F.col("b").alias("cluster")).distinct()
        clusters = write_table(clusters.join(starred, "cluster", "left").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to"))

    # Members that their leader's links do not reach ask their own group.
    members = _sized(clusters.select("row_key", F.col("cluster").alias("grp"), "share"))
    links = stars.where("link").select("a", "b")
    roots = connected(links)
    tied = roots.select(F.col("node").alias("row_key"), F.col("root").alias("_own")), roots.select(F.col("node").alias("grp"), F.col("root").alias("_lead"))
    asking = members.where("row_key <> grp").join(tied[0], "row_key", "left").join(tied[1], "grp", "left")
    asking = write_table(asking.where(F.coalesce("_own", "row_key") != F.coalesce("_lead", "grp")).select("row_key", "grp"))
    links = write_table(links.unionByName(_open(own, members, asking, percent).select("a", "b")))

    # Rows whose group is not their own: members of a leader's group, and all but one row of equal sets.
    moved = described.distinct().join(clusters.select(*same, "cluster"), same).where("row_key <> cluster").select("row_key", "cluster")
    placed = own.join(_small(write_table(moved)), "row_key", "left").select(F.coalesce("cluster", "row_key").alias("grp"), "text")
    # A first deal finds the tokens that crowd the prefixes; they move to the end of the order, so that the second makes few pairs.
    buckets = tables.width(spark)
    deal = lambda common: placed.mapInArrow(_prefixes(common, buckets, percent), _SHAPE)
    crowded = deal(frequent).groupBy("bucket").applyInArrow(text.tidy(_crowded), "token long, n long")
    top = crowded.orderBy(F.desc("n"), "token").limit(MOST_FREQUENT).select("token").toArrow()
    more = np.union1d(frequent.value, top.column("token").to_numpy().astype(np.int64).view(np.uint64))
    sent = deal(spark.sparkContext.broadcast(more))
    met = sent.groupBy("bucket").applyInArrow(text.tidy(_meet(percent)), "a long, b long, shared long, least long")
    pairs = write_table(met.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b"))

    # A group's id is its leader's key, so the smaller group of a pair asks by its id.
    rows = members.groupBy("grp").agg(F.first("rows").alias("rows"))
    of = lambda side: rows.select(F.col("grp").alias(side), F.col("rows").alias(f"n_{side}"))
    sides = pairs.join(of("a"), "a").join(of("b"), "b")
    smaller = F.col("n_a") <= F.col("n_b")
    sides = write_table(sides.select(F.when(smaller, F.col("a")).otherwise(F.col("b")).alias("row_key"), F.when(smaller, F.col("b")).otherwise(F.col("a")).alias("grp"), F.least("n_a", "n_b").alias("n_row")))
    links = write_table(links.unionByName(_open(own, members, sides.select("row_key", "grp"), percent).select("a", "b")))
    roots = connected(links)

    # Where the two groups are not one component, all members of the smaller ask.
    root = F.coalesce("root", "row_key")
    spans = members.join(roots.withColumnRenamed("node", "row_key"), "row_key", "left").groupBy("grp").agg(F.min(root).alias("low"), F.max(root).alias("high"))
    span = lambda side: spans.select(F.col("grp").alias(side), F.col("low").alias(f"low_{side}"), F.col("high").alias(f"high_{side}"))
    apart = sides.where("n_row > 1").join(span("row_key"), "row_key").join(span("grp"), "grp").where("least(low_row_key, low_grp) < greatest(high_row_key, high_grp)")
    third = members.select(F.col("row_key").alias("asks"), F.col("grp").alias("row_key")).join(apart.select("row_key", "grp"), "row_key")
    third = write_table(third.select(F.col("asks").alias("row_key"), "grp"))
    if third.take(1):
        roots = connected(links.unionByName(_open(own, members, third, percent).select("a", "b")))

    named = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    smallest = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = named.join(smallest, "root").select(*[F.col(c).alias(f"_{c}") for c in same], "component_id", "root")
    match = (F.col("sum") == F.col("_sum")) & (F.col("mix") == F.col("_mix")) & (F.col("n") == F.col("_n")) & (F.col("grp") == F.col("_grp"))
    return ids.join(named, match, "left").select("doc_id", "row_key", F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id"), F.coalesce("root", "row_key").alias("root"))
