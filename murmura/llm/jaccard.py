"""Near-duplicate classes by an exact Jaccard join over word shingles, with a token-group matrix.

Documents are partitioned into groups of similar ones; the matrix holds, for each token, the groups whose union has it.
A query document first bounds its overlap with a group's token union and opens only groups that can still qualify.

1. One pass gives each document its set of shingle hashes (size and a 128-bit name of the set) and counts all tokens of
   the corpus in a sketch of fixed size. Documents with the same set become one set.
2. A set of size n can reach the similarity only with sets that share one of its n - ceil(t n) + 1 first tokens in any
   fixed order, or l of its n - ceil(t n) + l first ones; l grows slowly with n (`needed`). Rare tokens (by the sketch) come first, so that
   common lines and passages are not among them. The first l tokens that two sets share also bound their overlap by the
   tokens after them, in either set.
3. The sets that share a first token are dealt into bands of sizes that can link. The set with the fewest rarer tokens
   leads its band: an original has none of the tokens that its edited copies add, so most copies link with it. Each set is
   compared with the leaders of its own and the two next bands and with the set before it (stars and a chain, not all
   pairs). A token that two sets have is done with then.
4. What linked is partitioned by component and band; a set that did not link is put with others of its band under the
   token of least hash that they share. The token-group matrix (token, group) gives each set the groups of other
   components that can still qualify by size and by the tokens after the shared ones, and of which it shares l tokens: one row for
   each set and group, with the number of tokens summed before sets are compared.
   A group is opened in steps: the union of all its members bounds the overlap, then the unions of 64 similar members
   each, and only members of those that qualify are compared.
5. Components of all links name the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import batches_of, connected_components, if_small, materialize, prepare, utf8
from .words import mix, windows, word_hashes

#: Buckets of the token sketch, in slices: 4 bytes each, whatever the corpus.
SKETCH_BITS, SLICES = 20, 16
#: Members of a union within a group, tokens of a group on average, and most queries of a group in one task.
GROUP, GROUP_TOKENS, QUERIES = 64, 1 << 18, 20_000
#: Set names that a task remembers to skip copies.
_SEEN = 200_000


def shingles(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text with A-Z in lower case; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(mix(windows(h := word_hashes(words), min(n, len(h))) + np.uint64(min(n, len(h)))))


def _name(tokens: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set: the first 63, which serve as its key, and 64 more, which tell sets of one key apart."""
    digest = xxhash.xxh3_128_intdigest(tokens.tobytes())
    return digest >> 65, (digest & (1 << 64) - 1) - (1 << 63)


def needed(size):
    """How many of their first tokens two sets that link share, by the size of the smaller; sets hardly larger than this share all that
    the similarity asks for."""
    return 2 + size // 64


#: The same in SQL.
_NEEDED = "(2 + floor(least({a}, {b}) / 64))"


def _key(tokens: np.ndarray, clashes: dict[int, list[int]]) -> int:
    """The key of a set. clashes: of keys that several sets have, the other 64 bits in order; all but the first get new keys,
    which are negative."""
    key, more = _name(tokens)
    if key in clashes and more != clashes[key][0]:
        return ~(key ^ xxhash.xxh3_64_intdigest(more.to_bytes(8, "little", signed=True)) >> 1)
    return key


def _describe(n: int, keep: tuple[str, ...] = ()):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, names, more, found = [], [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                tokens = shingles(text, n)
                found.append(tokens)
                sizes.append(len(tokens))
                name = _name(tokens) if len(tokens) and doc_id is not None else (None, None)
                names.append(name[0])
                more.append(name[1])
            if found:
                sketch += np.bincount(np.concatenate(found) >> np.uint64(64 - SKETCH_BITS), minlength=len(sketch)).astype(np.uint32)
            none = pa.nulls(len(sizes))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), pa.array(more, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary()), *(batch[c] for c in keep)], ["doc_id", "n_shingles", "set_id", "more", "slice", "counts", *keep])
        parts = [x.tobytes() for x in np.split(sketch, SLICES)]
        none = pa.nulls(SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(SLICES), pa.int32()), pa.array(parts, pa.binary()), *(none for _ in keep)], ["doc_id", "n_shingles", "set_id", "more", "slice", "counts", *keep])

    return run


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sum sketch slices, a row for each slice."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for k, counts in zip(batch["slice"].to_pylist(), batch["counts"].to_pylist(), strict=True):
            sums[k] = sums.get(k, 0) + np.frombuffer(counts, np.uint32).astype(np.float64)
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([np.minimum(x, 2**32 - 1).astype(np.uint32).tobytes() for x in sums.values()], pa.binary())], ["slice", "counts"])


def _levels(described: DataFrame) -> np.ndarray:
    """The sketch as eighths of powers of two: one byte a bucket, so 1 MB however large the corpus."""
    parts = described.where("slice is not null").select("slice", "counts")
    schema = "slice int, counts binary"
    rows = parts.repartition(16).mapInArrow(_add, schema).repartition(1).mapInArrow(_add, schema).collect()
    sums = np.concatenate([np.frombuffer(r.counts, np.uint32) for r in sorted(rows)])
    return np.minimum(np.log2(np.maximum(sums, 1).astype(np.float64)) * 8, 255).astype(np.uint8)


def _prefixes(levels, clashes: dict[int, list[int]], n: int, percent: int):
    """First tokens of every set, each set once a task. levels: a broadcast of the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            tokens, names, packed = [], [], []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), utf8(batch["text"]), strict=True):
                own = shingles(text, n)
                if doc_id is None or not len(own) or (name := _key(own, clashes)) in seen:
                    continue
                if len(seen) >= _SEEN:
                    seen.clear()
                seen.add(name)
                level = levels.value[own >> np.uint64(64 - SKETCH_BITS)]
                first = np.lexsort((own, level))[: len(own) - (percent * len(own) + 99) // 100 + needed(len(own))]
                splits = np.maximum(level[first].astype(np.int64) // 8 - 16, 0)  # powers of two: a token's rows are split beyond 65,536
                tokens.append(own[first].view(np.int64))
                names.append(np.full(len(first), name, np.int64))
                packed.append(splits << 56 | np.arange(len(first)) << 28 | len(own))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (tokens, names, packed)], ["token", "set_id", "packed"])

    return run


#: Rows of a token that wait for the rest of its rows; with more, they go on as they come.
_WAIT = 4_096
_SIZE, _PLACE = (1 << 28) - 1, (1 << 28) - 1


def _width(percent: int) -> float:
    """Bands of sizes by ln(size): sizes that can link are in one band or two that follow each other."""
    return 0.999 / np.log(100 / percent) if percent < 100 else 1e3


def _stars(percent: int):
    """Of rows sorted by token, salt, band, place and set: rows of tokens that two sets have, with the leaders of their own
    band, the one under and the one over, and the set before, each where both can still link. posted: a third set may have
    the token."""

    def near(size, rest, other_size, other_rest):
        fits = 100 * np.minimum(size, other_size) >= percent * np.maximum(size, other_size)
        before = needed(np.minimum(size, other_size)) - 1  # shared tokens that may stand before this one
        return fits & ((np.minimum(rest, other_rest) + before) * (100 + percent) >= percent * (size + other_size))

    def band_of(packed):
        return np.floor(np.log(packed & _SIZE) * _width(percent))

    def describe(rows: np.ndarray, carried: tuple | None, goes_on: bool = False) -> tuple[pa.RecordBatch, tuple]:
        """rows: (token, set, packed) by column, of whole tokens, or the next ones of a token with carried rows: the leader of
        the last band, the one of the band under it (or None), the last row. goes_on: rows are of one token, and more of it
        may come. Returns what to carry, too."""
        token, name, packed = rows
        splits = packed >> 56
        salt = name & ((1 << splits) - 1)
        head = np.ones(len(token), bool)
        head[1:] = (token[1:] != token[:-1]) | (salt[1:] != salt[:-1])
        again = np.zeros(len(token), bool)
        again[1:] = ~head[1:] & (name[1:] == name[:-1])
        if carried:
            head[0], again[0] = False, name[0] == carried[2][1]
        keep = ~again
        token, name, packed, splits, head = (x[keep] for x in (token, name, packed, splits, head))
        size, place, band, at = packed & _SIZE, packed >> 28 & _PLACE, band_of(packed), np.arange(len(token))
        opens = head.copy()
        opens[1:] |= band[1:] != band[:-1]
        if carried and len(token):
            opens[0] = band[0] != band_of(carried[2][2])
        # before the rows stand the carried ones: the leader under, the leader, the last row; of size 0 where there is none
        extra = [carried[1] or (0, -1, 0), carried[0], carried[2]] if carried else [(0, -1, 0)] * 3
        names, packs = (np.concatenate([[row[i] for row in extra], x]).astype(np.int64) for i, x in ((1, name), (2, packed)))
        heads, own = np.flatnonzero(opens), np.cumsum(opens) + 1
        leaders, begins = np.concatenate([[0, 1], heads + 3, [0]]), np.concatenate([[False, False], head[heads], [True]])
        others = [(leaders[own], leaders[own] != at + 3), (leaders[own - 1], ~begins[own]), (leaders[own + 1], ~begins[own + 1]), (at + 2, ~head)]
        columns = []
        for other, there in others:
            n, p = names[other], packs[other]
            s = p & _SIZE
            columns.append((n, there & (s > 0) & near(size, size - place, s, s - (p >> 28 & _PLACE))))
        run = np.cumsum(head)
        total = np.bincount(run, minlength=run[-1] + 1 if len(run) else 1)[run] if len(run) else run
        total = np.where((run == 0) | goes_on, _WAIT, total)  # run 0 goes on from rows before
        posted = (total > 2) | (splits > 0)
        linked = np.logical_or.reduce([ok for _, ok in columns])
        use = (total > 1) & (posted | linked) | (splits > 0)
        pick = lambda x, ok: pa.array(x[use], mask=~ok[use])
        batch = pa.RecordBatch.from_arrays(
            [pa.array(x[use]) for x in (token, name, size, place)] + [pick(*c) for c in columns] + [pa.array((splits[use] > 0) & head[use]), pa.array(posted[use])],
            ["token", "set_id", "size", "place", "leader", "under", "over", "before", "heads_salt", "posted"],
        )
        if not len(token):
            return batch, carried
        row = lambda i: tuple(int(x) for x in (token[i], name[i], packed[i])) if i >= 0 else None
        leader = row(heads[-1]) if len(heads) else carried[0]
        below = row(heads[-2]) if len(heads) > 1 and not head[heads[-1]] else carried[0] if carried and len(heads) == 1 and not head[heads[-1]] else carried[1] if carried and not len(heads) else None
        return batch, (leader, below, row(len(token) - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, carried = np.empty((3, 0), np.int64), None
        for batch in batches:
            rows = np.concatenate([waiting, np.stack([batch[c].to_numpy() for c in ("token", "set_id", "packed")])], 1)
            if not rows.shape[1]:
                continue
            salt = rows[1] & ((1 << (rows[2] >> 56)) - 1)
            changes = np.flatnonzero((rows[0][1:] != rows[0][:-1]) | (salt[1:] != salt[:-1])) + 1
            if carried and (rows[0][0] != carried[2][0] or salt[0] != carried[2][1] & ((1 << (carried[2][2] >> 56)) - 1)):
                carried = None
            cut = int(changes[-1]) if len(changes) else 0
            if cut:
                yield describe(rows[:, :cut], carried)[0]
                carried = None
            waiting = rows[:, cut:]
            if waiting.shape[1] > _WAIT or carried:
                made, carried = describe(waiting, carried, goes_on=True)
                yield made
                waiting = waiting[:, :0]
        if waiting.shape[1]:
            yield describe(waiting, None)[0]

    return run


class _Matrix:
    """Tokens to the columns (members, or unions of members) that have them."""

    def __init__(self, columns: list[np.ndarray]) -> None:
        tokens = np.concatenate(columns)
        of = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        order = np.argsort(tokens, kind="stable")
        tokens, self.of, self.n = tokens[order], of[order], len(columns)
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        self.tokens, self.first = tokens[first], np.append(first, len(tokens))

    def common(self, own: np.ndarray) -> np.ndarray:
        """How many of own each column has."""
        at = np.searchsorted(self.tokens, own)
        at[at == len(self.tokens)] = 0
        at = at[self.tokens[at] == own]
        start, n = self.first[at], self.first[at + 1] - self.first[at]
        rows = np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else at
        return np.bincount(self.of[rows], minlength=self.n)


class _Group:
    """A group's members under unions of GROUP similar ones, and which of the sets that were compared hang together."""

    def __init__(self, members: dict[int, np.ndarray], percent: int) -> None:
        self.percent, self.up = percent, {}
        names = sorted(members, key=lambda m: (members[m][0], m))  # the least hash of similar sets is often the same
        self.parts = [names[i : i + GROUP] for i in range(0, len(names), GROUP)]
        self.members = members
        self.least = np.array([min(len(members[m]) for m in p) for p in self.parts])
        unions = [np.unique(np.concatenate([members[m] for m in p])) for p in self.parts]
        self.union, self.unions = np.unique(np.concatenate(unions)), _Matrix(unions)
        self.opened: dict[int, _Matrix] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def links(self, name: int, own: np.ndarray) -> Iterator[int]:
        """Members that own links with, but for those that earlier links have joined with it."""
        least = np.maximum(self.least, -(-self.percent * len(own) // 100))
        if (100 + self.percent) * _common(own, self.union) < self.percent * (len(own) + least.min()):
            return
        for k in np.flatnonzero((100 + self.percent) * self.unions.common(own) >= self.percent * (len(own) + least)):
            part = self.parts[k]
            if k not in self.opened:
                self.opened[k] = _Matrix([self.members[m] for m in part])
            both = self.opened[k].common(own)
            sizes = np.array([len(self.members[m]) for m in part])
            for i in np.flatnonzero((100 + self.percent) * both >= self.percent * (len(own) + sizes)):
                a, b = self.root(name), self.root(part[i])
                if a != b:
                    self.up[a] = b
                    yield part[i]


def _open(clashes: dict[int, list[int]], n: int, percent: int):
    """Rows sorted by group and salt, members before queries: links of queries to members of their groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members, opened = None, {}, None
        for batch in batches:
            links: list[tuple[int, int]] = []
            rows = zip(*(batch[c].to_pylist() for c in ("group_id", "salt", "kind", "set_id")), utf8(batch["text"]), strict=True)
            for g, salt, kind, name, text in rows:
                if (g, salt) != group:
                    group, members, opened = (g, salt), {}, None
                own = shingles(text, n)
                if not len(own) or _key(own, clashes) != name:  # another text under the same id
                    continue
                if kind == 0:
                    members[name] = own
                elif members:
                    opened = opened or _Group(members, percent)
                    links += [(name, other) for other in opened.links(name, own)]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    if not len(b):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def _clashes(sets: DataFrame) -> dict[int, list[int]]:
    """Keys that several sets have, with the other 64 bits of their names: about n * n / 2**64 of n sets, so none or a few."""
    several = sets.where("set_id is not null").groupBy("set_id").agg(F.min("more").alias("lo"), F.max("more").alias("hi")).where("lo <> hi")
    return {r.set_id: [r.lo, r.hi] for r in several.select("set_id", "lo", "hi").collect()}


def _reach(rest: str, other_rest: str, size: str, other_size: str, percent: int, before: str = "0") -> str:
    """SQL: sets of these sizes can still link if they share a token with so many from it on in either, and `before` at most before it."""
    return f"(least({rest}, {other_rest}) + {before}) * {100 + percent} >= {percent} * ({size} + {other_size})"


def _verify(docs: DataFrame, first: DataFrame, members: DataFrame, queries: DataFrame, clashes: dict[int, list[int]], n: int, percent: int) -> DataFrame:
    """Links of queries (group_id, set_id) to members (group_id, set_id). first: the document (doc_id) of each set_id.

    A group with many queries is dealt out by salt, with its members (GROUP_TOKENS tokens on average) in each part.
    """
    queries = materialize(queries, "queries")
    splits = queries.groupBy("group_id").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("parts"))
    asked = queries.join(splits, "group_id").select("group_id", F.expr("pmod(set_id, parts)").alias("salt"), F.lit(1).alias("kind"), "set_id")
    opened = members.join(splits, "group_id").select("group_id", F.explode(F.expr("sequence(0L, parts - 1)")).alias("salt"), F.lit(0).alias("kind"), "set_id")
    rows = materialize(opened.union(asked).join(first, "set_id"), "compare")
    return (
        docs.join(if_small(rows), "doc_id").select("group_id", "salt", "kind", "set_id", "text")
        .repartition("group_id", "salt").sortWithinPartitions("group_id", "salt", "kind")
        .mapInArrow(_open(clashes, n, percent), "a long, b long")
    )


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 75, tell_texts: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id[, text_id, component]) for each row of docs: documents link when 100 * |intersection| >= percent * |union|.

    component_id is the least id reachable by links, the document's own included. A text without words (null, empty) has
    an empty set and links with nothing; so does a row with a null id, whose component is null. Repeated rows come out as
    often as they came in. An empty table gives an empty result; other columns are not read. With tell_texts, text_id (a hash
    of the text) tells rows of the same id apart, and component names the group, null for an empty set or a null id.
    """
    spark = docs.sparkSession
    prepare(spark)
    told = ("text_id",) if tell_texts else ()
    all_docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[F.xxhash64(F.col(text_col)).alias(c) for c in told])
    docs = all_docs.select("doc_id", "text")
    described = materialize(all_docs.mapInArrow(_describe(n, told), "doc_id long, n_shingles long, set_id long, more long, slice int, counts binary" + ", text_id long" * tell_texts), "sets")
    levels = spark.sparkContext.broadcast(_levels(described))
    sets = described.where("slice is null").select("doc_id", "n_shingles", "set_id", "more", *told)
    clashes = _clashes(sets)
    if clashes:
        known = F.create_map(*[F.lit(x) for k, v in clashes.items() for x in (k, v[0])])
        renamed = F.udf(lambda key, more: ~(key ^ xxhash.xxh3_64_intdigest(more.to_bytes(8, "little", signed=True)) >> 1), "long")
        sets = sets.withColumn("set_id", F.when(F.col("more") != known[F.col("set_id")], renamed("set_id", "more")).otherwise(F.col("set_id")))
    first = materialize(sets.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "first")

    prefixes = docs.mapInArrow(_prefixes(levels, clashes, n, percent), "token long, set_id long, packed long")
    salt = F.expr("set_id & (shiftleft(1L, cast(shiftright(packed, 56) as int)) - 1)")
    size, place = F.expr(f"packed & {_SIZE}"), F.expr(f"shiftright(packed, 28) & {_PLACE}")
    with batches_of(spark, 8_192):
        posts = materialize(
            prefixes.repartition(F.col("token"), salt).sortWithinPartitions(F.col("token"), salt, F.floor(F.ln(size) * F.lit(float(_width(percent)))), place, F.col("set_id"))
            .mapInArrow(_stars(percent), "token long, set_id long, size long, place long, leader long, under long, over long, before long, heads_salt boolean, posted boolean"), "stars",
        )
    salted = posts.where("heads_salt").select("token", "set_id")
    heads = salted.groupBy("token").agg(F.min("set_id").alias("group_id"))
    met = salted.join(heads, "token").where("group_id <> set_id").select("group_id", "set_id")
    pairs = posts.select(F.explode(F.array_distinct(F.array("leader", "under", "over", "before"))).alias("b"), F.col("set_id").alias("a")).where("b is not null")
    # met from both sides or for several tokens, a pair is compared once
    pairs = pairs.union(met.select(F.col("group_id").alias("b"), F.col("set_id").alias("a"))).groupBy(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).agg(F.min("b").alias("group_id"))
    stars = materialize(pairs.select("group_id", F.when(F.col("group_id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("set_id")), "pairs")
    links = materialize(_verify(docs, first, stars.select("group_id", F.col("group_id").alias("set_id")).distinct(), stars, clashes, n, percent), "links")

    parts = materialize(connected_components(links), "parts")
    sizes = parts.groupBy("component").agg(F.count("*").alias("members"))
    parts = materialize(parts.join(sizes, "component").select(F.col("node").alias("set_id"), "component", "members"), "members")
    own = posts.where("posted").select("token", "set_id", "size", "place").join(parts, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    own = materialize(own, "own")
    mixed = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    own = materialize(own.join(mixed, "token"), "mixed")

    of_set = own.groupBy("set_id").agg(F.first("size").alias("size"), F.first("component").alias("component"), F.first("members").alias("members"), F.min(F.struct(F.xxhash64("token").alias("h"), "token"))["token"].alias("home"))
    # a component is opened with all its sets, those too whose tokens are not asked for here
    cluster = F.when(F.col("members").isNull(), F.xxhash64("home", "band")).otherwise(F.xxhash64("component", "band", F.lit(1)))
    of_set = of_set.withColumn("band", F.floor(F.ln("size") * F.lit(float(_width(percent))))).withColumn("cluster", cluster)
    of_set = materialize(of_set.select("set_id", "size", "cluster"), "clusters")
    tokens = of_set.groupBy("cluster").agg(F.sum("size").alias("tokens"))
    groups = of_set.join(tokens, "cluster").select("set_id", F.xxhash64("cluster", F.expr(f"pmod(xxhash64(set_id), ceil(tokens / {GROUP_TOKENS}))")).alias("group_id"))
    groups = materialize(groups, "groups")
    own = materialize(own.join(groups, "set_id"), "grouped")
    matrix = own.groupBy("token", "group_id").agg(F.max("members").alias("g_members"), F.max("component").alias("g_component"), F.min("size").alias("lo"), F.max("size").alias("hi"), F.max(F.col("size") - F.col("place")).alias("rest"))
    turn = (  # of two sets that meet, which one asks: the one that is not linked, or that of the smaller component or group
        "case when g_members is not null then members is null or members < g_members or members = g_members and component < g_component "
        "else members is null and own_group <= group_id end"
    )
    met = own.withColumnRenamed("group_id", "own_group").join(matrix, "token").where(
        f"{turn} and {percent} * size <= 100 * hi and {percent} * lo <= 100 * size and " + _reach("size - place", "rest", "size", "lo", percent, "size div 64 + 1")
    )
    # shared tokens are summed before sets are opened: the first one must reach, and there must be as many as the sizes need
    sums = met.groupBy("group_id", "set_id").agg(F.count("*").alias("shared"), F.bool_or(F.expr(_reach("size - place", "rest", "size", "lo", percent))).alias("reaches"), F.max("size").alias("size"), F.min("lo").alias("lo"))
    enough = f"shared >= least({_NEEDED.format(a='size', b='lo')}, ceil({percent} * size / 100))"
    asked = materialize(sums.where(f"reaches and {enough}").select("group_id", "set_id"), "asked")
    more = materialize(_verify(docs, first, groups.join(asked.select("group_id").distinct(), "group_id").select("group_id", "set_id"), asked, clashes, n, percent), "more")

    joined = connected_components(links.union(more)).select(F.col("node").alias("set_id"), "component")
    named = first.join(joined, "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = materialize(named.join(least, "component").select("set_id", "component_id", *["component"] * tell_texts), "named")
    return sets.join(named, "set_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), *told, *["component"] * tell_texts)
