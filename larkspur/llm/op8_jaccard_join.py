"""Exact Jaccard join on word n-grams with prefix filters under several global token orders, and its connected groups.

The set of a document is its distinct word n-grams (hashes of 64 bits).  Documents of equal sets are one node.  Two
sets as similar as asked share one of the first |x| - ceil(t |x|) + 1 n-grams of each under any order of all n-grams.  Nodes that
share such a prefix under the first order are candidates; those that do not share one under the second and the third order as
well are dropped; what is left is verified on the whole sets.

The first order is by frequency.  One n-gram in ``COUNTED`` (by its hash) is counted over all documents and comes first, the
rarest first; the others follow; n-grams of more than about one node in ``HOT_SHARE`` come last in all orders.  The n-grams that
only one node has can't be shared, so they fill prefixes without a posting, and most documents have none.

How groups are found without all pairs of a group: the nodes of a prefix n-gram are first compared with one of them, that
with the least share of n-grams of its own, which joins nearly all near copies.  Only pairs of nodes that are still in
different groups are then compared with each other.  N-grams that more than ``LIST`` of such nodes hold are left to the
prefixes under the second order, and the third, which the nodes that hold them share too if they are similar.  Pairs whose sets
must differ in too many n-grams, by the parities of their n-grams' hash classes, don't leave the join.
Links between nodes of one group add nothing to it, so the groups are exact.

Links and groups stay in Spark.  Each stage's result is a table in the shared folder.  What is broadcast is the list of hot
n-grams (at most 2 x HOT_SHARE x the mean size of a set) and, if there are at most ``FEW``, the keys of the documents whose sets are
compared.  Postings of hot n-grams are dealt over ``SALTS`` parts, each with a hub of its own.

Defined results: a null or empty text has no n-grams, is linked with nothing and is its own group; a text of fewer words than n
is one n-gram; rows of equal id and text share a result, a row each; the smallest id of a group names it (a null id is never
the smallest unless there is no other); at 100 percent only equal sets are grouped; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm import common

#: Words of an n-gram, and the least similarity in percent.
WORDS, PERCENT = 3, 90
#: One n-gram in so many is counted exactly.
COUNTED = 3
#: N-grams that one node in so many has at least come last in all orders; some of up to half that share do too.
HOT_SHARE = 32
#: N-grams that a counting task holds at a time.
HELD = 1_000_000
#: Parts that the postings of a hot n-gram are dealt over.
SALTS = 64
#: Nodes of different groups with an n-gram in common that are compared by it; beyond that the next order decides.
LIST = 256
#: Words of 64 bits in the parities of a set.
PARITIES = 8
#: Keys that may be broadcast; beyond that the texts are shuffled to them.
FEW = 500_000

_SALTS = tuple(np.uint64(x) for x in (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25, 0xD1342543DE82EF95, 0x8CB92BA72F3D8DD7))
RARE, PLAIN, HOT = 0, 1, 2


def sets_of(part: pa.RecordBatch, column: int, n: int):
    """The sorted distinct n-gram hashes of each text of a batch."""
    data, at = common.text_bytes(part.column(column))
    words = common.Words(common.LOWER[data], at)
    value, begin = words.shingles(n)
    cut = np.searchsorted(begin, words.first)
    for k, count in enumerate(words.counts.tolist()):
        if count >= n:
            yield np.unique(value[cut[k] : cut[k + 1]])
        elif count:
            with np.errstate(over="ignore"):
                whole = np.uint64(0x51ED270B0A1F39C1) + np.uint64(count)
                for w in words.hash[words.first[k] : words.first[k + 1]]:
                    whole = common.mix(np.array([whole * np.uint64(0xA0761D6478BD642F) + w]))[0]
            yield np.array([whole], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def node_of(own: np.ndarray) -> int:
    """A hash of a set."""
    with np.errstate(over="ignore"):
        return int(common.mix(np.add.reduce(common.mix(own ^ _SALTS[0])) * np.uint64(2 * len(own) + 1) + np.bitwise_xor.reduce(common.mix(own ^ _SALTS[1]), initial=np.uint64(0)) + np.zeros(1, np.uint64)).view(np.int64)[0])


def is_hot(own: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which n-grams are in a sorted list."""
    return hot[np.minimum(np.searchsorted(hot, own), len(hot) - 1)] == own if len(hot) else np.zeros(len(own), bool)


def prefix_size(size: int, percent: int) -> int:
    """How many n-grams of a set, first under any order, two similar sets cannot miss."""
    return size - (percent * size + 99) // 100 + 1


def prefix(own: np.ndarray, hot: np.ndarray, order: int, percent: int) -> np.ndarray:
    """The prefix of a set under the second (1) or third (2) order: by hash, hot n-grams last."""
    size = prefix_size(len(own), percent)
    rank = (is_hot(own, hot).astype(np.uint64) << np.uint64(63)) | (common.mix(own ^ _SALTS[order]) >> np.uint64(1))
    return own[np.argpartition(rank, size - 1)[:size]] if size < len(own) else own


def postings(own: np.ndarray, hot: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """N-grams of a set that may be in its first prefix, each with its kind as the last two bits; and how many of the last
    counted ones are not in it."""
    size = prefix_size(len(own), percent)
    rank = common.mix(own ^ _SALTS[0])
    kind = np.where(is_hot(own, hot), HOT, np.where(rank % np.uint64(COUNTED) == 0, RARE, PLAIN)).astype(np.uint64)
    chosen, drop = np.flatnonzero(kind == RARE), 0
    if len(chosen) >= size:
        drop = len(chosen) - size
    else:
        rest = np.flatnonzero(kind != RARE)
        later = (kind[rest] == HOT).astype(np.uint64) << np.uint64(63) | rank[rest] >> np.uint64(1)
        chosen = np.concatenate([chosen, rest[np.argsort(later)[: size - len(chosen)]]])
    return own[chosen] & ~np.uint64(3) | kind[chosen], drop


def parities(own: np.ndarray) -> np.ndarray:
    """For each of 64 x PARITIES hash classes whether a set has an odd number of n-grams in it, as 64-bit integers."""
    classes = (common.mix(own ^ _SALTS[3]) % np.uint64(64 * PARITIES)).astype(np.int64)
    return np.packbits((np.bincount(classes, minlength=64 * PARITIES) & 1).astype(np.uint8)).view(np.int64)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.col(text).alias("text"))


def _scan(rows: DataFrame, n: int) -> DataFrame:
    """doc_id, row_hash, node and size of each row; and, with a count instead, n-grams that are frequent in some task."""
    names = ["doc_id", "row_hash", "node", "size", "count"]

    def frequent(held: list[np.ndarray]) -> pa.RecordBatch:
        found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        some = counts >= max(2, len(held) / (2 * HOT_SHARE))
        none = pa.nulls(int(some.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, pa.array(common.signed(found[some])), none.cast(pa.int32()), pa.array(counts[some].astype(np.int64))], names)

    def run(batches):
        held, size, done = [], 0, set()
        for part in common.slices(batches):
            nodes, sizes = [], []
            for own in sets_of(part, 2, n):
                node = node_of(own)
                nodes.append(node)
                sizes.append(len(own))
                if len(own) and node not in done:
                    done.add(node)
                    held.append(own)
                    size += len(own)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int32()), pa.nulls(len(nodes), pa.int64())], names)
            if size > HELD:
                yield frequent(held)
                held, size = [], 0
        yield frequent(held)

    return rows.mapInArrow(run, "doc_id long, row_hash long, node long, size int, count long")


def _hot(scanned: DataFrame) -> np.ndarray:
    """N-grams of many nodes, sorted: all that one node in HOT_SHARE has, and none that less than a quarter as many have.

    What a node in HOT_SHARE has is, but for at most half of those nodes, in tasks of which it has half that share, and counted there.
    """
    nodes = scanned.where(F.col("count").isNull() & (F.col("size") > 0)).agg(F.approx_count_distinct("node")).first()[0]
    found = scanned.where(F.col("count").isNotNull()).groupBy("node").agg(F.sum("count").alias("count")).where(F.col("count") >= max(2.0, nodes / (4 * HOT_SHARE)))
    return np.sort(found.select("node").toArrow().column("node").to_numpy().view(np.uint64))


def _postings(rows: DataFrame, hot, n: int, percent: int) -> DataFrame:
    """token, node, size and drop (see ``postings``); sets too small to have a similar other set have none."""

    def run(batches):
        done: set[int] = set()
        for part in common.slices(batches):
            tokens, nodes, sizes, drops, lengths = [np.zeros(0, np.uint64)], [], [], [], []
            for own in sets_of(part, 2, n):
                if len(own) * (100 - percent) < percent:
                    continue
                node = node_of(own)
                if node in done:
                    continue
                done.add(node)
                chosen, drop = postings(own, hot.value, percent)
                tokens.append(chosen)
                for values, x in ((nodes, node), (sizes, len(own)), (drops, drop), (lengths, len(chosen))):
                    values.append(x)
            spread = lambda values, kind: pa.array(np.repeat(np.array(values, kind), lengths))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(common.signed(np.concatenate(tokens))), spread(nodes, np.int64), spread(sizes, np.int32), spread(drops, np.int32)], ["token", "node", "size", "drop"])

    return rows.mapInArrow(run, "token long, node long, size int, drop int")


def _first_prefixes(rows: DataFrame, hot, n: int, percent: int) -> DataFrame:
    """token, salt, node, size and common: the first prefixes of all nodes, as far as another node has the n-gram.

    common is how many of a thousand n-grams of a node are counted ones that another node has too.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = F.col("token").bitwiseAND(3)
    dealt = _postings(rows, hot, n, percent).withColumn("salt", F.when(kind == HOT, F.pmod("node", F.lit(SALTS))).otherwise(0).cast("int"))
    holders = Window.partitionBy("token", "salt")
    counted = dealt.repartition(parts, "token", "salt").withColumn("n", F.count("*").over(holders)).withColumn("low", F.min("node").over(holders)).withColumn("high", F.max("node").over(holders))
    counted = counted.where((F.col("low") < F.col("high")) | (kind == HOT))
    level = F.floor(F.log2(F.col("n").cast("double")))
    own = Window.partitionBy("node")
    # only counted n-grams are ever dropped: with others in the prefix, drop is 0
    last = own.orderBy(level.desc(), F.xxhash64("token").desc())
    kept = counted.withColumn("place", F.row_number().over(last)).withColumn("common", (F.count("*").over(own) * 1000 / F.col("size")).cast("int")).where(F.col("place") > F.col("drop"))
    return kept.select("token", "salt", "node", "size", "common").distinct()


def _sets(rows: DataFrame, hot, n: int, percent: int) -> DataFrame:
    """node, size, its n-grams, its prefixes under the second and the third order (32 bits of each n-gram) and its parities."""
    names = ["node", "size", "grams", "second", "third", *(f"p{k}" for k in range(PARITIES))]

    def run(batches):
        done: set[int] = set()
        for part in common.slices(batches):
            found = {}
            for own in sets_of(part, 2, n):
                node = node_of(own)
                if len(own) and node not in done:
                    found[node] = own
                    done.add(node)
            if found:
                sets = list(found.values())
                short = lambda order: pa.array([(prefix(own, hot.value, order, percent) & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32) for own in sets], pa.list_(pa.int32()))
                bits = np.stack([parities(own) for own in sets])
                columns = [pa.array(list(found), pa.int64()), pa.array([len(own) for own in sets], pa.int32()), pa.array([common.signed(own) for own in sets], pa.list_(pa.int64())), short(1), short(2)]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(np.ascontiguousarray(bits[:, k])) for k in range(PARITIES)], names)

    return rows.mapInArrow(run, "node long, size int, grams array<long>, second array<int>, third array<int>, " + ", ".join(f"p{k} long" for k in range(PARITIES)))


def _rows_of(wanted: DataFrame, rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """A row of each node in wanted (and its repetitions)."""
    one = nodes.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct("doc_id", "row_hash")).alias("row"))
    one = common.materialize(one.select(F.col("row.doc_id").alias("w_id"), F.col("row.row_hash").alias("w_hash")), "compared")
    few = F.broadcast(one) if one.count() <= FEW else one
    return rows.join(few, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("row_hash") == F.col("w_hash")), "left_semi")


def _may_be_similar(percent: int):
    """Whether sets a and b may be similar by their sizes and parities: sets that differ in d n-grams differ in d parities at most."""
    x, y = F.col("a_size"), F.col("b_size")
    differ = sum((F.bit_count(F.col(f"a_p{k}").bitwiseXOR(F.col(f"b_p{k}"))) for k in range(PARITIES)), F.lit(0))
    return (100 * F.least(x, y) >= percent * F.greatest(x, y)) & ((100 + percent) * differ <= (100 - percent) * (x + y))


def _named(sets: DataFrame, side: str, *columns: str) -> DataFrame:
    """Columns of sets for one side of a pair; its node is called a or b."""
    return sets.select(F.col("node").alias(side), *(F.col(c).alias(f"{side}_{c}") for c in columns))


_BITS = tuple(f"p{k}" for k in range(PARITIES))


def _similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) of nodes that share prefixes under the other orders too and are similar by their whole sets."""
    slim = ("size", "second", "third", *_BITS)
    near = pairs.join(_named(sets, "a", *slim), "a").join(_named(sets, "b", *slim), "b")
    near = near.where(_may_be_similar(percent) & F.arrays_overlap("a_second", "b_second") & F.arrays_overlap("a_third", "b_third")).select("a", "b")
    both = near.join(_named(sets, "a", "grams"), "a").join(_named(sets, "b", "grams"), "b")
    shared = both.select("a", "b", F.size(F.array_intersect("a_grams", "b_grams")).cast("long").alias("both"), (F.size("a_grams") + F.size("b_grams")).cast("long").alias("all"))
    return common.materialize(shared.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"), "links")


def connected(links: DataFrame) -> DataFrame:
    """node and group (its smallest node) of all nodes in links (a, b), by alternating large and small stars.

    Each round makes every node point at the smallest node next to it; rounds grow with the logarithm of a chain's length.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """edges (v, m) with v > m; large: all larger neighbours of each node move to the least, small: all smaller ones do."""
        around = edges.union(edges.select(F.col("m").alias("v"), F.col("v").alias("m"))) if large else edges
        least = around.groupBy("v").agg(F.min("m").alias("low")).select(F.col("v").alias("u"), F.least("low", "v").alias("low"))
        joined = around.join(least, F.col("v") == F.col("u"))
        if large:
            moved = joined.where(F.col("m") > F.col("u")).select(F.col("m").alias("v"), F.col("low").alias("m"))
            return moved.distinct()
        return joined.select(F.col("m").alias("v"), F.col("low").alias("m")).union(least.select(F.col("u").alias("v"), F.col("low").alias("m"))).where("v > m").distinct()

    edges = common.materialize(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("m")).where("v > m").distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("v", "m").cast("decimal(20,0)")).alias("h")).first()
        if state == now or not now.n:
            return edges.select(F.col("v").alias("node"), F.col("m").alias("group"))
        state = now
        edges = common.materialize(star(star(edges, True), False), "edges")


def _stars(shared: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the hub of its n-gram's part, and the hubs of a hot n-gram's parts with one of them."""
    hub = F.min(F.struct((-F.col("common")).alias("rest"), "node", "size")).alias("hub")
    hubs = shared.groupBy("token", "salt").agg(hub, F.max("node").alias("high"), F.min("node").alias("low"))
    # most n-grams are gone from all prefixes but one
    within = shared.join(hubs.where("low < high").select("token", "salt", F.col("hub.node").alias("a")), ["token", "salt"]).select("a", F.col("node").alias("b"))
    top = hubs.where(F.col("token").bitwiseAND(3) == HOT)
    first = top.groupBy("token").agg(F.min("hub").alias("first")).select("token", F.col("first.node").alias("a"))
    return within.union(top.join(first, "token").select("a", F.col("hub.node").alias("b"))).where("a <> b").distinct()


def _unlinked(shared: DataFrame, sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of nodes of different groups that share a prefix under the first order and may be similar."""
    placed = lambda keys: keys.join(groups, "node", "left").select("key", "node", F.coalesce("group", "node").alias("group"))

    def opened(keys: DataFrame) -> DataFrame:
        """Keys that nodes of several groups have, with how many."""
        several = keys.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.count("*").alias("n")).where("low < high").select("key", "n")
        return keys.join(several, "key")

    def listed(keys: DataFrame) -> DataFrame:
        slim = ("size", *_BITS)
        x, y = (keys.select("key", F.col("group").alias(f"{s}_group"), F.col("node").alias(s)).join(_named(sets, s, *slim), s) for s in "ab")
        return x.join(y, (x["key"] == y["key"]) & (F.col("a") < F.col("b")) & (F.col("a_group") != F.col("b_group")) & _may_be_similar(percent)).select("a", "b")

    found, keys = None, shared.select(F.col("token").alias("key"), "node")
    for further in ("second", "third", None):
        keys = common.materialize(opened(placed(keys)), "open")
        these = listed(keys.where(F.col("n") <= LIST) if further else keys)
        found = these if found is None else found.union(these)
        many = keys.where(F.col("n") > LIST).select("node").distinct()
        if further is None or many.isEmpty():
            break
        keys = sets.join(many, "node", "left_semi").select(F.explode(F.col(further).cast("array<long>")).alias("key"), "node")
    return common.materialize(found.distinct(), "pairs")


def jaccard_groups(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row_hash, n_shingles, node (hash of the set) and component_id of each row."""
    with common.scratch(docs.sparkSession):
        placed = _placed(_rows(docs, doc_id, text), n, percent)
    # a set without n-grams is no set: its rows are groups of their own
    some, none = placed.where(F.col("size") > 0), placed.where(F.col("size") == 0)
    # written, so that the rows of a large group can be split in the join
    least = common.materialize(some.groupBy("group").agg(F.min("doc_id").alias("least")), "least", keep=True)
    joined = some.join(least, "group").select("doc_id", "row_hash", "size", "node", "least")
    both = joined.union(none.select("doc_id", "row_hash", "size", "node", F.col("doc_id").alias("least")))
    return both.select("doc_id", "row_hash", F.col("size").cast("long").alias("n_shingles"), "node", F.col("least").alias("component_id"))


def _placed(rows: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, row_hash, node, size and the smallest node of the group of each row, as a kept table."""
    spark = rows.sparkSession
    scanned = common.materialize(_scan(rows, n), "nodes")
    nodes = scanned.where(F.col("count").isNull()).select("doc_id", "row_hash", "node", "size")
    hot = spark.sparkContext.broadcast(_hot(scanned))
    shared = common.materialize(_first_prefixes(rows, hot, n, percent), "shared")
    sets = common.materialize(_sets(_rows_of(shared.select("node").distinct(), rows, nodes), hot, n, percent), "sets")
    groups = connected(_similar(_stars(shared), sets, percent))
    pairs = _unlinked(shared, sets, groups, percent)
    if not pairs.isEmpty():
        groups = connected(_similar(pairs, sets, percent).union(groups.select(F.col("group").alias("a"), F.col("node").alias("b"))))
    placed = nodes.join(groups, "node", "left").select("doc_id", "row_hash", "node", "size", F.coalesce("group", "node").alias("group"))
    placed = common.materialize(placed, "placed", keep=True)
    hot.destroy()
    return placed


def keep_one_of_each(docs: DataFrame, n: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with all its columns, whatever their names, and one row of each group: that of the smallest id, and of equal ids the
    one of least text hash; of rows of equal id and text any one.  Rows without words all stay."""
    found = jaccard_groups(docs, n, percent, doc_id, text).where("n_shingles > 0")
    key = F.struct(F.col("doc_id").isNull(), "doc_id", "row_hash")
    first = found.groupBy(F.col("component_id").alias("group")).agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1")
    several = found.join(first, F.col("component_id").eqNullSafe(F.col("group")))
    # a row's fate: 0 goes, 1 is the first one; that may stand for several rows of equal id and text
    fate = several.groupBy("doc_id", "row_hash").agg(F.max(key.eqNullSafe(F.col("first")).cast("int")).alias("stays"), F.count("*").alias("n"))
    fate = common.materialize(fate.where("stays = 0 or n > 1"), "fate", keep=True)
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("r_id"), F.xxhash64(text).alias("r_hash"))
    few = F.broadcast(fate) if fate.count() <= FEW else fate
    same = F.col("r_id").eqNullSafe(F.col("doc_id")) & (F.col("r_hash") == F.col("row_hash"))
    kept = rows.join(few, same, "left_anti").select("row")
    repeated = fate.where("stays = 1")
    if not repeated.isEmpty():
        kept = kept.union(rows.join(repeated, same).groupBy("r_id", "r_hash").agg(F.any_value("row").alias("row")).select("row"))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(common.read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), r AS (
  SELECT g, count(*) AS df FROM s GROUP BY g
), p AS (
  SELECT doc_id, g, n FROM (
    SELECT doc_id, g, n, row_number() OVER (PARTITION BY doc_id ORDER BY df, g) AS k FROM s JOIN r USING (g) JOIN n USING (doc_id))
  WHERE k <= n - (90 * n + 99) // 100 + 1
), c AS (
  SELECT DISTINCT x.doc_id AS a, y.doc_id AS b, x.n AS an, y.n AS bn
  FROM p x JOIN p y ON x.g = y.g AND x.doc_id < y.doc_id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
), l AS (
  SELECT a, b FROM (SELECT a, b, an, bn, count(*) AS o FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b AND y.g = x.g GROUP BY ALL)
  WHERE 100 * o >= 90 * (an + bn - o)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), t AS (
  SELECT a AS doc_id, a AS reached FROM e UNION SELECT t.doc_id, e.b FROM t JOIN e ON e.a = t.reached
), m AS (
  SELECT doc_id, min(reached) AS least FROM t GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.least, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
