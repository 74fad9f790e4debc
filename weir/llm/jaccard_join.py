"""N-gram Jaccard join by grouped prefixes, and the components of its links.

1. Texts with one and the same shingle set are one *class*; from here on only one document of a class counts.
2. Shingles get a global order: rarer levels of document frequency first, then by hash. A document's prefix is its
   first n - ceil(t n) + 1 shingles; two sets that reach the threshold t share one there. Shingles that no other class
   has can't be shared, so a document whose prefix is made of those alone is done.
3. Classes with identical prefixes and sizes make one *group*; groups that share a prefix shingle, and whose sizes and
   places of that shingle allow t, are group pairs, which are expanded to their members, and those verified on whole sets.
4. Links are only needed as far as they join components: first each group of a shingle is held against one pivot,
   twice; then, exactly, all pairs between groups that share a shingle and are still in different components.
5. Where pairing the groups that share a shingle would cost more than dividing their list, it is divided: sets that
   reach t share a second shingle among their first n - ceil(t n) + 2, and a third, so the next shingle parts the list, up
   to LEVELS in common. Lists are paired block by block, each block in a task of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weir.llm.blobs import Chunk, Keys, chunked, layout
from weir.llm.common import LOWER, U64, fresh_prefix, mix, slices, stored, stream, word_hashes, words
from weir.llm.components import components

WIDTH = 4
THRESHOLD = (85, 100)
#: Bytes of a shingle's key for document frequencies, beside the bits of its bucket: they only decide on an order.
KEY_BYTES = 3
#: Bytes of a shingle in sets that are compared pair by pair.
SET_BYTES = 6
PIVOT_ROUNDS = 2
#: Shingles in common by which long lists are divided, and the length up to which a list isn't long.
LEVELS = 3
BLOCK = 64
#: Pairs that take as long as a row of a divided list, and units of a block that the others are paired with.
ROW_COST = 50
PAIRED = 512
#: Rows of a shingle's list that are joined to its pivot in one place.
SALT_ROWS = 256
_M = stream(64, 11) | U64(1)


class Shingles(Chunk):
    """A chunk with the sorted distinct shingle hashes of each document."""

    def __init__(self, rows: pa.Table, width: int):
        super().__init__(rows)
        self.sets: list[np.ndarray] = []
        for a, b in slices(self.off):
            lo = self.off[a]
            data = LOWER[self.data[lo : self.off[b]]]
            starts, first = words(data, self.off[a : b + 1] - lo)
            h = word_hashes(data, starts)
            gram = np.zeros(max(0, len(h) - width + 1), U64)
            for j in range(width):
                gram += h[j : len(h) - width + 1 + j] * _M[j] if len(gram) else U64(0)
            gram = mix(gram) if len(gram) else gram
            for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if e - s >= width:
                    self.sets.append(np.unique(gram[s : e - width + 1]))
                elif e > s:  # the whole sequence, told from others by its length
                    total = U64(e - s)
                    for j in range(s, e):
                        total = mix((total + h[j : j + 1]) * _M[width + j - s])
                    self.sets.append(total)
                else:
                    self.sets.append(np.zeros(0, U64))

    def numbers(self) -> np.ndarray:
        return np.array([len(x) for x in self.sets], np.int64)


def fingerprint(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


class Counted(Keys):
    """Keys with the number of documents that have them."""

    def rows(self, chunk: int) -> pa.Table:
        out = super().rows(chunk)
        many = []
        for a, b in zip(self.at[:-1], self.at[1:], strict=True):
            n = self.counts[a:b]
            at = np.flatnonzero(n > 1)
            many.append(np.stack([at, n[at]], 1).astype(np.int64).tobytes())
        return out.append_column("many", pa.array(many, pa.binary()))

    def levels(self, answer: pa.Table) -> np.ndarray:
        """For each item the level of its key's document frequency."""
        raw = dict(zip(answer.column("bucket").to_pylist(), answer.column("bits").to_pylist(), strict=True))
        if not len(self.keys):
            return np.zeros(0, np.uint8)
        return np.frombuffer(b"".join(raw[b] for b in self.buckets.tolist()), np.uint8)[self.inverse]


def frequency_levels(rows: pa.Table) -> pa.Table:
    """Decide for a bucket: the number of bits of each key's document frequency, 1 for one document."""
    raw, many = rows.column("keys").to_pylist(), rows.column("many").to_pylist()
    size = np.array([len(x) // KEY_BYTES for x in raw])
    wide = np.zeros((int(size.sum()), 4), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, KEY_BYTES)
    count = np.ones(len(wide), np.int64)
    ends = np.cumsum(size)
    for m, at in zip(many, ends - size, strict=True):
        pairs = np.frombuffer(m, np.int64).reshape(-1, 2)
        count[pairs[:, 0] + at] = pairs[:, 1]
    _, inverse = np.unique(wide.view(np.uint32).ravel(), return_inverse=True)
    total = np.bincount(inverse, weights=count).astype(np.int64)
    level = (np.floor(np.log2(total)).astype(np.uint8) + 1)[inverse] if len(wide) else np.zeros(0, np.uint8)
    bits = [level[e - n : e].tobytes() for n, e in zip(size, ends, strict=True)]
    return pa.table({"chunk": rows.column("chunk"), "bucket": rows.column("bucket"), "bits": pa.array(bits, pa.binary())})


def short(shingles: np.ndarray) -> bytes:
    return np.ascontiguousarray(shingles >> U64(64 - 8 * SET_BYTES)).view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes()


def common(a: bytes, b: bytes) -> int:
    wide = np.zeros(((len(a) + len(b)) // SET_BYTES, 8), np.uint8)
    wide[:, :SET_BYTES] = np.frombuffer(a + b, np.uint8).reshape(-1, SET_BYTES)
    x = np.sort(wide.view(U64).ravel())
    return int(np.count_nonzero(x[1:] == x[:-1]))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Of the pairs (u, v) those whose sets reach the threshold."""
    one = pairs.join(sets.select(F.col("node").alias("u"), F.col("items").alias("a")), "u")
    two = one.join(sets.select(F.col("node").alias("v"), F.col("items").alias("b")), "v").select("u", "v", "a", "b")

    def run(batches):
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a"), batch.column("b"), strict=True):
                a, b = a.as_py(), b.as_py()
                both = common(a, b)
                keep.append(den * both >= num * ((len(a) + len(b)) // SET_BYTES - both))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return two.mapInArrow(run, "u binary, v binary")


def jaccard_join(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", detail: bool = False) -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, the smallest id that links lead to, itself included.

    With detail two columns more: component, a key of the component (null without shingles), and text_md5, by which rows
    of one id can be told apart.

    A document's set holds the distinct runs of `width` words, lower-cased in A-Z, or its whole sequence if it has
    fewer words. Two documents link when threshold[1] * common >= threshold[0] * (size of the union). Documents
    without words or with a null text have no shingles, link with nothing and are their own component. Rows of
    equal id are documents of their own; a null id counts as larger than any other and is a component's id only
    where there is none else. Ids are read as bigint, other columns aren't looked at, empty tables give no rows. A very
    long text is one set like any other: it is shingled whole, in the memory of one task.
    """
    num, den = threshold
    chunks, buckets = layout(docs)
    source = chunked(docs, id_col, text_col, chunks)

    def describe(rows: pa.Table) -> pa.Table:
        c = Shingles(rows, width)
        n = c.numbers()
        return pa.table({
            "id": c.ids, "chunk": pa.array(np.full(len(n), c.number), pa.int32()), "row": pa.array(np.arange(len(n)), pa.int32()),
            "n": pa.array(n, pa.int64()), "node": pa.array([fingerprint(x) if len(x) else None for x in c.sets], pa.binary()),
            **({"md5": pa.array([hashlib.md5(c.data[a:b].tobytes(), usedforsecurity=False).hexdigest() for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist(), strict=True)], pa.string())} if detail else {}),
        })

    members = stored(source.groupBy("chunk").applyInArrow(describe, "id bigint, chunk int, row int, n bigint, node binary" + (", md5 string" if detail else "")))
    classes = members.filter("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("id"), F.min(F.struct("chunk", "row")).alias("at"))
    chosen = stored(classes.select("node", "id", "at.chunk", "at.row"))
    reps = chosen.select("chunk", F.col("row").alias("bucket"), F.lit(None).cast("binary").alias("bits"))

    def picked(c: Shingles, rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the classes' documents, and all their shingles."""
        at = np.sort(rows.column("bucket").to_numpy())
        return at, np.concatenate([c.sets[k] for k in at.tolist()]) if len(at) else np.zeros(0, U64)

    def send(rows: pa.Table, mine: pa.Table) -> pa.Table:
        if not rows.num_rows or not mine.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "chunk": pa.array([], pa.int32()), "keys": pa.array([], pa.binary()), "many": pa.array([], pa.binary())})
        c = Shingles(rows, width)
        return Counted(picked(c, mine)[1], buckets, KEY_BYTES).rows(c.number)

    sent = source.groupBy("chunk").cogroup(reps.groupBy("chunk")).applyInArrow(send, "bucket int, chunk int, keys binary, many binary")
    levels = sent.groupBy("bucket").applyInArrow(frequency_levels, "chunk int, bucket int, bits binary")
    told = levels.withColumn("kind", F.lit(1)).unionByName(reps.withColumn("kind", F.lit(0)))
    kinds = (("node", pa.binary()), ("n", pa.int64()), ("grp", pa.binary()), ("own", pa.int32()), ("core", pa.int32()), ("prefix", pa.list_(pa.int64())), ("items", pa.binary()))

    def index(rows: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {k: [] for k, _ in kinds}
        mine = told.filter(pc.equal(told.column("kind"), 0))
        if rows.num_rows and mine.num_rows:
            c = Shingles(rows, width)
            at, items = picked(c, mine)
            level = Counted(items, buckets, KEY_BYTES).levels(told.filter(pc.equal(told.column("kind"), 1)))
            stop = 0
            for k in at.tolist():
                s = c.sets[k]
                n, start, stop = len(s), stop, stop + len(s)
                p = n - -(-num * n // den) + 1
                rank = level[start:stop]
                alone = int(np.count_nonzero(rank == 1))
                if alone >= p:
                    continue
                first = np.argsort(rank, kind="stable")[: p + LEVELS - 1]  # the set is in order of hash
                out["node"].append(fingerprint(s))
                out["n"].append(n)
                out["grp"].append(hashlib.blake2b(s[first].tobytes() + n.to_bytes(8, "little"), digest_size=16).digest())
                out["own"].append(alone)
                out["core"].append(p - alone)
                out["prefix"].append(s[first[alone:]].view(np.int64))
                out["items"].append(short(s))
        return pa.table({k: pa.array(out[k], t) for k, t in kinds})

    table = source.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(index, "node binary, n bigint, grp binary, own int, core int, prefix array<bigint>, items binary")
    table = stored(table, "jaccard")
    roots = _linked(table, num, den)
    # the component of a class, then of every document
    top = chosen.select("node", "id").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    ids = top.groupBy("root").agg(F.min("id").alias("component_id"))
    named = top.join(ids, "root").select("node", "component_id", "root")
    empty = F.col("node").isNull()
    out = members.filter(~empty).join(named, "node").select("id", "n", "component_id", "root", *(["md5"] if detail else []))
    out = out.unionByName(members.filter(empty).select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("binary").alias("root"), *(["md5"] if detail else [])))
    kind = docs.schema[id_col].dataType
    more = [F.col("root").alias("component"), F.col("md5").alias("text_md5")] if detail else []
    return out.select(F.col("id").cast(kind).alias(id_col), F.col("n").alias("n_shingles"), F.col("component_id").cast(kind).alias("component_id"), *more)


def without_near_copies(docs: DataFrame, width: int = WIDTH, threshold: tuple[int, int] = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of documents that stay, as they are: one of each component, that of the smallest id.

    Rows of one id are told apart by their texts; of several in one component the least MD5 stays. Documents without
    shingles stay. A null id is larger than any other. Rows equal in id and text stay or go together.
    """
    q = fresh_prefix(docs.columns)
    found = stored(jaccard_join(docs, width, threshold, id_col, text_col, detail=True).filter("component IS NOT NULL"))
    row = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("text_md5").alias("md5"))
    leaders = found.groupBy("component").agg(F.min(row).alias("r"), F.count("*").alias("c")).filter("c > 1").select("component", "r.*")
    went = found.select(F.col(id_col).alias("i"), F.col("text_md5").alias("m"), "component").join(leaders, "component").filter("NOT (i <=> id AND m = md5)")
    went = went.select(F.col("i").alias(f"{q}i"), F.col("m").alias(f"{q}m")).distinct()
    key = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    rows = docs.withColumn(f"{q}k", key)
    return rows.join(went, (F.col(f"{q}k") == F.col(f"{q}m")) & F.col(id_col).eqNullSafe(F.col(f"{q}i")), "left_anti").select(*docs.columns)


def _linked(table: DataFrame, num: int, den: int) -> DataFrame:
    """(node, root) of all classes that have a link."""
    sets = table.select("node", "items")
    nodes = table.select("node", "n", "grp")
    groups = table.groupBy("grp").agg(F.min("node").alias("rep"), *(F.first(c).alias(c) for c in ("n", "own", "core", "prefix")))
    posts = groups.select(F.posexplode(F.slice("prefix", F.lit(1), F.col("core"))).alias("idx", "token"), "grp", "rep", "n", "own", "core")
    posts = posts.withColumn("pos", F.col("idx") + F.col("own")).drop("own")
    # a shingle in one group only has nothing to join; a long list is dealt to several places of its pivot
    shared = posts.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1")
    shared = stored(shared.select("token", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts")))
    posts = stored(posts.join(shared, "token"))
    crowd = stored(nodes.groupBy("grp").agg(F.count("*").alias("c")).filter("c > 1").select("grp", F.ceil(F.col("c") / SALT_ROWS).cast("int").alias("salts")))
    crowded = nodes.join(crowd, "grp")

    edges = None
    roots = nodes.select("node", F.col("node").alias("root")).filter("false")
    for k in range(PIVOT_ROUNDS):
        at = _rooted(posts.select("token", "salts", F.col("rep").alias("node"), "n", "pos"), roots)
        # the pivot has few shingles before this one, so it is near to many
        near = F.struct(F.floor(F.col("pos") / (1 + 3 * k)), F.xxhash64("node", F.lit(k)))
        pairs = _against(at, "token", near, ("node", "n", "root", "pos")).filter(f"x.root <> y.root AND {_fits(num, den)}")
        inner = _against(_rooted(crowded, roots), "grp", F.xxhash64("node", F.lit(k)), ("node", "root")).filter("x.root <> y.root")
        ends = (F.col("x.node").alias("u"), F.col("y.node").alias("v"))
        found = verified(_distinct(pairs.select(*ends).unionByName(inner.select(*ends))), sets, num, den)
        edges = stored(found if edges is None else edges.unionByName(found))
        roots = components(edges)

    # What is left, exactly. A unit is a group that is in one component, or else each of its members.
    placed = stored(_rooted(nodes, roots))
    span = placed.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    whole = span.filter("low = high").select("grp", F.col("low").alias("root"), F.col("grp").alias("unit"))
    torn = placed.join(span.filter("low <> high").select("grp"), "grp", "left_semi").select("grp", "root", F.col("node").alias("unit"))
    both = whole.unionByName(torn)
    units = posts.select(F.col("token").alias("key"), "grp", "n", "pos", "idx", (F.col("core") - F.col("idx")).alias("width")).join(both, "grp")
    found = []
    for level in range(1, LEVELS + 1):
        units, split = _split(units)
        direct = f"{level == LEVELS} OR c <= {BLOCK} OR (c - most) * c <= {ROW_COST} * wide"
        found.append(_by_blocks(units.join(split.filter(direct), "key"), _fits(num, den, level - 1)))
        many = split.filter(f"NOT ({direct})")
        if level == LEVELS or many.isEmpty():
            break
        units = _divided(units.join(many, "key"), groups, level, num, den)
    pairs = union_all(found).distinct()
    member = whole.select("grp", "unit").join(nodes, "grp").select("unit", "node").unionByName(torn.select("unit", F.col("unit").alias("node")))
    pairs = pairs.join(member.select(F.col("unit").alias("a"), F.col("node").alias("u")), "a").join(member.select(F.col("unit").alias("b"), F.col("node").alias("v")), "b").select("u", "v")
    torn = torn.select(F.col("grp").alias("key"), "unit", "root", F.lit(0).alias("width"), F.lit(0).alias("n"), F.lit(0).alias("pos"))
    torn, split = _split(torn)
    inside = _by_blocks(torn.join(split, "key"), "true").select(F.col("a").alias("u"), F.col("b").alias("v"))
    last = verified(_distinct(pairs.unionByName(inside)), sets, num, den)
    return components(stored(edges.unionByName(last)))


def _fits(num: int, den: int, seen: int = 0) -> str:
    """Whether the sizes of x and y allow the threshold, and, with `seen` shingles in common before this one, what follows does."""
    return f"{den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND {num + den} * ({seen} + least(x.n - x.pos, y.n - y.pos)) >= {num} * (x.n + y.n)"


def _against(rows: DataFrame, key: str, near: Column, columns: tuple[str, ...]) -> DataFrame:
    """Each row x with the pivot y of its key, the row of the least `near`. A long list is joined in `salts` places, so
    that no task has all rows of a hot key."""
    pivots = rows.groupBy(key).agg(F.min_by(F.struct(*columns), near).alias("p"), F.first("salts").alias("salts"))
    pivots = pivots.select(key, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "p.*")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("salts")
    return dealt.alias("x").join(pivots.alias("y"), [key, "salt"])


def _split(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The units, and the keys that have more than one component with their figures: c units, `most` of them in the
    component `main`, and `wide` rows if they were divided. Both are stored, so that a join of them can be split at a hot
    key."""
    units = stored(units)
    sizes = units.groupBy("key", "root").agg(F.count("*").alias("c"), F.sum("width").alias("w"))
    split = sizes.groupBy("key").agg(F.count("*").alias("roots"), F.max_by("root", F.struct("c", "root")).alias("main"), F.max("c").alias("most"), F.sum("c").alias("c"), F.sum("w").alias("wide"))
    return units, stored(split.filter("roots > 1").drop("roots"))


def _divided(units: DataFrame, groups: DataFrame, level: int, num: int, den: int) -> DataFrame:
    """The lists of `level` shingles in common, divided by the next one.

    Of two sets that reach the threshold the shingle in common of number level + 1 is among the first
    core + level of either. Only sets that need no more than `level` in common may be without one; they are a list too.
    """
    rows = units.join(groups.select("grp", "own", "core", "prefix"), "grp")
    after = F.slice("prefix", F.col("idx") + 2, F.greatest(F.lit(0), F.col("core") + F.lit(level - 1) - F.col("idx")))
    rest = ("grp", "unit", "root", "n")
    more = rows.select("key", *rest, "own", "core", "idx", F.posexplode(after).alias("j", "token"))
    at = F.col("idx") + 1 + F.col("j")
    width = F.greatest(F.lit(0), F.col("core") + F.lit(level) - at)
    more = more.select(F.xxhash64("key", "token").alias("key"), *rest, (F.col("own") + at).alias("pos"), at.cast("int").alias("idx"), width.cast("int").alias("width"))
    short = rows.filter(f"{num} * n <= {den * level}")
    ended = short.select(F.xxhash64("key", F.lit("end")).alias("key"), *rest, "pos", F.size("prefix").alias("idx"), F.lit(0).alias("width"))
    return more.unionByName(ended)


def _by_blocks(units: DataFrame, allow: str) -> DataFrame:
    """(a, b): the units of each key that are in different components, paired exactly. All but those of a key's main
    component go to every block of the key's units, so that a task holds a block of them and what it is paired with."""
    blocks = F.ceil(F.col("c") / PAIRED).cast("int")
    rows = units.select("key", "unit", "root", "main", "n", "pos", blocks.alias("blocks"))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))
    rest = rows.filter("root <> main").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = rest.alias("x").join(blocked.alias("y"), ["key", "block"]).filter(f"x.root <> y.root AND (y.root = y.main OR x.unit < y.unit) AND {allow}")
    return pairs.select(F.col("x.unit").alias("a"), F.col("y.unit").alias("b"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _distinct(pairs: DataFrame) -> DataFrame:
    return pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
