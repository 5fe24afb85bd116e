"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures, confirmed on full sets.

Words are lower-cased (A-Z) runs of anything but the six ASCII blanks; a document's set holds its distinct
shingles of five words, or its whole sequence if it has fewer. Documents whose sets have a Jaccard
likeness of at least 75 in 100 are linked, and a component is named by its smallest id.

A signature has 48 lanes of 16 bits, each the low bits of one minimum. It is split into 12 chunks of four
lanes. Two signatures that differ in at most 23 lanes have a chunk that differs in at most one (were all 12 to
differ in two or more, 24 lanes would), so indexing every chunk with each lane left out in turn meets all
pairs under the distance. A pair at the likeness 0.75 differs in 12 lanes on average, and in more than 23
with probability 0.00015; that is the only way to miss a link.

Documents of equal sets are one class from the start. In buckets of up to ``SMALL`` classes every pair within
the distance is confirmed. In a larger bucket all classes are confirmed against its least one; only if it then
still spans several components are its classes compared across components. Those that no link can join are told
apart by their rare shingles (a prefix filter over all such classes), and within what remains the classes outside the main
component meet the rest in blocks of bounded size, by an inverted index of the shingles in the block. No link found
through a bucket is lost, no bucket is capped and pairs are not listed. Keys of more than ``HOT_ROWS`` rows are dealt over as
many tasks as they need.

Empty and null texts and texts without words have no set and no links. A row without id cannot be named:
it keeps its place with a null component and is kept. Rows of one id are one node, whatever their texts: the id links the
classes of its rows, and all its rows get one component. Repeated rows give repeated results. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import deal_hot_keys, materialise, read_table, split_by_ids
from .components import connected_components

WORDS, LIKENESS = 5, 75
CHUNKS, LANES, BITS = 12, 4, 16
DISTANCE = 2 * CHUNKS - 1
SMALL = 32
BLOCK_SHINGLES = 50_000
HOT_ROWS = 20_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

_ODD = np.random.RandomState(20240607).randint(0, 2**32, (2, CHUNKS * LANES), dtype=np.uint64).astype(np.uint32)
_TIMES, _PLUS = (_ODD[0] | np.uint32(1))[:, None], _ODD[1][:, None]
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().translate(LOWER).split()
    if len(words) < WORDS:
        return np.array([xxh3_64_intdigest(b" ".join(words))] if words else [], dtype=np.uint64)
    hashes = np.fromiter(map(xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    count = len(words) - WORDS + 1
    rolled = hashes[:count]
    for k in range(1, WORDS):
        rolled = _mix(rolled * _STEP + hashes[k : k + count])
    return np.unique(rolled)


def signature(shingles: np.ndarray) -> np.ndarray:
    """12 signed longs of four 16-bit lanes."""
    low, high = shingles.astype(np.uint32), (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(CHUNKS * LANES, 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), 2048):
        x = low[at : at + 2048] * _TIMES + _PLUS
        x ^= x >> np.uint32(15)
        x ^= high[at : at + 2048]
        x *= _TIMES
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=1), out=least)
    return (least & np.uint32(0xFFFF)).astype("<u2").view("<i8")


SIGNED = "doc_id long, n_shingles long, set_hi long, set_lo long, " + ", ".join(f"s{c} long" for c in range(CHUNKS))


def _sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from xxhash import xxh3_128_digest

    for batch in batches:
        table = np.zeros((len(batch), 3 + CHUNKS), dtype=np.int64)
        for row, text in zip(table, batch["text"], strict=True):
            shingles = shingle_set(text)
            row[0] = len(shingles)
            if len(shingles):
                row[1:3] = np.frombuffer(xxh3_128_digest(shingles.tobytes()), dtype=np.int64)
                row[3:] = signature(shingles)
        out = pd.DataFrame(table, columns=["n_shingles", "set_hi", "set_lo", *[f"s{c}" for c in range(CHUNKS)]])
        out.insert(0, "doc_id", batch["doc_id"].to_numpy())
        yield out


def _shingled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.iloc[at : at + 256]
            yield pd.DataFrame({"doc_id": part["doc_id"].to_numpy(), "shingles": [shingle_set(x).view(np.int64) for x in part["text"]]})


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _lanes_off(x: Column, y: Column) -> Column:
    """How many of the four lanes of two longs differ: fold each lane's bits into its lowest and count those."""
    z = x.bitwiseXOR(y)
    for shift in (8, 4, 2, 1):
        z = z.bitwiseOR(F.shiftrightunsigned(z, shift))
    return F.bit_count(z.bitwiseAND(F.lit(0x0001000100010001)))


def _keys(classes: DataFrame) -> DataFrame:
    """(rep, key): every chunk with each lane left out; the key's low six bits number chunk and lane."""
    keys = []
    for c in range(CHUNKS):
        for j in range(LANES):
            rest = F.col(f"s{c}").bitwiseAND(F.lit(_signed(((1 << 64) - 1) ^ (0xFFFF << (BITS * j)))))
            number = c * LANES + j
            keys.append(F.xxhash64(F.lit(number), rest).bitwiseAND(F.lit(-64)).bitwiseOR(F.lit(number).cast("long")))
    return classes.select("rep", F.explode(F.array(*keys)).alias("key"))


def _close_pairs(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b) of one bucket within the distance, each pair met once: through its first chunk with at most one
    differing lane, that lane left out (the first one if none differs)."""
    rows = members.join(classes.select("rep", *[f"s{c}" for c in range(CHUNKS)]), "rep").select("key", "rep", *[f"s{c}" for c in range(CHUNKS)])
    left = rows.select("key", F.col("rep").alias("a"), *[F.col(f"s{c}").alias(f"x{c}") for c in range(CHUNKS)])
    right = rows.select(F.col("key").alias("k"), F.col("rep").alias("b"), *[F.col(f"s{c}").alias(f"y{c}") for c in range(CHUNKS)])
    off = [_lanes_off(F.col(f"x{c}"), F.col(f"y{c}")) for c in range(CHUNKS)]
    total = off[0]
    for one in off[1:]:
        total = total + one
    first = None
    for c in range(CHUNKS):
        differ = F.col(f"x{c}").bitwiseXOR(F.col(f"y{c}"))
        lane = F.lit(0)
        for j in range(LANES - 1, 0, -1):
            lane = F.when(differ.bitwiseAND(F.lit(_signed(0xFFFF << (BITS * j)))) != 0, F.lit(j)).otherwise(lane)
        hit = (off[c] <= 1, lane + c * LANES)
        first = F.when(*hit) if first is None else first.when(*hit)
    on = (F.col("key") == F.col("k")) & (F.col("a") < F.col("b")) & (total <= DISTANCE) & (first == F.col("key").bitwiseAND(F.lit(63)))
    return left.join(right, on).select("a", "b")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the likeness."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
    rows = pairs.join(left, "a").join(right, "b")
    rows = rows.withColumn("common", F.size(F.array_intersect("x", "y")))
    return rows.filter(100 * F.col("common") >= LIKENESS * (F.size("x") + F.size("y") - F.col("common"))).select("a", "b")


def _linked_in_block(block: pd.DataFrame) -> pd.DataFrame:
    """The pairs of components that an outer and an inner row of a block link."""
    outer, inner = block[block["outer"]], block[~block["outer"]]
    found = set()
    if len(outer) and len(inner):
        sizes = inner["shingles"].map(len).to_numpy()
        values = np.concatenate(inner["shingles"].to_numpy())
        order = np.argsort(values, kind="stable")
        values, owners = values[order], np.repeat(np.arange(len(inner)), sizes)[order]
        comps = inner["comp"].to_numpy()
        for comp, own in zip(outer["comp"], outer["shingles"], strict=True):
            lo, hi = np.searchsorted(values, own, "left"), np.searchsorted(values, own, "right")
            runs = hi - lo
            at = np.repeat(lo - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            common = np.bincount(owners[at], minlength=len(inner))
            hits = (100 * common >= LIKENESS * (len(own) + sizes - common)) & (comps != comp)
            found.update((int(comp), other) for other in np.unique(comps[hits]).tolist())
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def _prefix_clusters(nodes: DataFrame) -> DataFrame:
    """(node, cluster): rows of (rep, comp, shingles) that a link between components may join, by shared rare shingles.

    Under any order of the shingles, two sets within the likeness share one of the first n - ceil(0.75 n) + 1 of each. Here
    shingles that occur in one component only, which no link between components shares, come first and the others by
    rising frequency. So rows that share nothing but widespread passages fall apart, however many they are.
    """
    words = nodes.select("rep", "comp", F.xxhash64("shingles").alias("part"), F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    shared = words.groupBy("s").agg(F.count("*").alias("times"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    shared = materialise(shared.select(F.col("s").alias("its"), "times"), "shared")
    met = deal_hot_keys(words, "s", F.xxhash64("rep"), shared, "its", "times", HOT_ROWS)
    rows = met.groupBy("rep", "comp", "part", "n").agg(F.array_sort(F.collect_list(F.struct("times", "s"))).alias("found"))
    room = F.col("n") - F.ceil(F.lit(LIKENESS) * F.col("n") / 100) + 1 - (F.col("n") - F.size("found"))
    firsts = rows.withColumn("room", room.cast("int")).filter("room > 0").select("rep", "comp", F.explode(F.slice("found", F.lit(1), F.col("room"))).alias("f"))
    firsts = materialise(firsts.select("rep", "comp", "f.s"), "prefixes")
    leaders = firsts.groupBy("s").agg(F.min("rep").alias("leader"), F.count("*").alias("times"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi")
    leaders = leaders.select(F.col("s").alias("its"), "leader", "times")
    edges = deal_hot_keys(firsts.select("s", "rep"), "s", F.xxhash64("rep"), leaders, "its", "times", HOT_ROWS).select("rep", "leader").distinct()
    return connected_components(edges, "rep", "leader").withColumnRenamed("component", "cluster")


def _across_components(crowded: DataFrame, comps: DataFrame, sets: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of components that a link within a large bucket joins; None if every such bucket lies in one already."""
    rows = crowded.join(comps, crowded["rep"] == comps["node"], "left").select("key", "rep", "size", F.coalesce("component", "rep").alias("comp"))
    rows = materialise(rows, "crowded")
    mixed = rows.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("size").alias("rows")).filter("lo <> hi").select(F.col("key").alias("k"), "rows")
    rows = materialise(deal_hot_keys(rows, "key", F.xxhash64("rep"), mixed, "k", "rows", HOT_ROWS).select("rep", "comp").distinct(), "mixed")
    if rows.isEmpty():
        return None
    nodes = rows.join(sets, F.col("rep") == F.col("doc_id")).select("rep", "comp", "shingles")
    clusters = _prefix_clusters(nodes)
    nodes = materialise(nodes.join(clusters, F.col("rep") == F.col("node")).select("cluster", "rep", "comp", "shingles"), "cluster")
    parts = nodes.groupBy("cluster", "comp").agg(F.sum(F.size("shingles")).alias("n"), F.count("*").alias("rows"))
    main = parts.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("most"), F.sum("rows").alias("rows"))
    main = main.select(
        F.col("cluster").alias("its"), "main", "rows",
        F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("inner_blocks"),
        F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("most")) / BLOCK_SHINGLES).cast("int")).alias("outer_blocks"),
    )
    hashed = F.xxhash64("rep")
    nodes = deal_hot_keys(nodes, "cluster", hashed, main, "its", "rows", HOT_ROWS)
    inner = nodes.select("cluster", "rep", "comp", "shingles", F.lit(False).alias("outer"), F.pmod(hashed, F.col("inner_blocks")).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("outer_blocks") - 1)).alias("o"))
    outer = nodes.filter("comp <> main").select("cluster", "rep", "comp", "shingles", F.lit(True).alias("outer"), F.explode(F.sequence(F.lit(0), F.col("inner_blocks") - 1)).alias("i"), F.pmod(hashed, F.col("outer_blocks")).cast("int").alias("o"))
    blocks = inner.unionByName(outer).withColumn("block", F.xxhash64("cluster", "i", "o"))
    return blocks.select("block", "rep", "comp", "shingles", "outer").groupBy("block").applyInPandas(_linked_in_block, "a long, b long")


def _repeated_ids(signed: DataFrame) -> DataFrame:
    """(repeated_id, several): ids of more than one row, and whether these hold different sets."""
    sets = [f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("set_hi", "set_lo")]
    rows = signed.groupBy("doc_id").agg(F.count("*").alias("rows"), *sets).filter("rows > 1")
    return rows.select(F.col("doc_id").alias("repeated_id"), F.expr("lo_set_hi <> hi_set_hi OR lo_set_lo <> hi_set_lo").alias("several"))


def _full_sets(texts: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """(doc_id, shingles), once for every set of an id."""
    shape = "doc_id long, shingles array<long>"
    if repeated is None:
        return texts.mapInPandas(_shingled, shape)
    on = texts["doc_id"] == repeated["repeated_id"]
    again = texts.join(repeated, on, "left_semi").mapInPandas(_shingled, shape).withColumn("part", F.xxhash64("shingles"))
    again = again.groupBy("doc_id", "part").agg(F.min("shingles").alias("shingles")).drop("part")
    return texts.join(repeated, on, "left_anti").mapInPandas(_shingled, shape).unionByName(again)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    named = source.filter("doc_id IS NOT NULL")
    signed = materialise(named.mapInPandas(_sign, SIGNED), "signed")
    lanes = [f"s{c}" for c in range(CHUNKS)]
    whole = ["set_hi", "set_lo", "n_shingles"]
    classes = signed.filter("n_shingles > 0").groupBy(*whole, *lanes).agg(F.min("doc_id").alias("rep"))
    classes = materialise(classes, "classes")
    repeated = materialise(_repeated_ids(signed), "repeated")
    repeated = None if repeated.isEmpty() else repeated

    keys = _keys(classes)
    buckets = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("size")).filter("size > 1")
    buckets = materialise(buckets, "buckets")  # a table of its own, so that a hot key's side of the join can be split
    members = materialise(keys.join(buckets, "key").select("key", "rep", "leader", "size"), "members")
    crowded = members.filter(F.col("size") > SMALL)
    pairs = _close_pairs(members.filter(F.col("size") <= SMALL), classes)
    pairs = pairs.unionByName(crowded.filter("rep <> leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct())
    pairs = materialise(pairs, "pairs")

    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).unionByName(crowded.select(F.col("rep").alias("a"))).distinct()
    wanted = materialise(wanted, "wanted")
    _, texts = split_by_ids(named, "doc_id", wanted, "a")
    sets = materialise(_full_sets(texts.join(wanted, F.col("doc_id") == F.col("a"), "left_semi"), repeated), "sets")
    links = _confirmed(pairs, sets)
    if repeated is not None:  # an id is one node: it links the classes that its rows belong to
        several = signed.join(repeated.filter("several"), F.col("doc_id") == F.col("repeated_id"), "left_semi").filter("n_shingles > 0")
        links = links.unionByName(several.select("doc_id", *whole).distinct().join(classes, whole).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")))
    comps = connected_components(links, "a", "b")
    more = None if crowded.isEmpty() else _across_components(crowded, comps, sets)
    if more is not None:
        joined = connected_components(more, "a", "b").select(F.col("node").alias("part"), F.col("component").alias("of"))
        # the least of a component's nodes names it, so a component without links is a node that has no row yet
        lone = joined.join(comps, F.col("part") == F.col("node"), "left_anti").select(F.col("part").alias("node"), F.col("of").alias("component"))
        comps = comps.join(joined, F.col("component") == F.col("part"), "left").select("node", F.coalesce("of", "component").alias("component")).unionByName(lone)
    named_classes = classes.join(comps, F.col("rep") == F.col("node"), "left").select(*whole, F.coalesce("component", "rep").alias("component"))
    rows = signed.filter("n_shingles > 0").select("doc_id", *whole).join(named_classes, whole).select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    bare = signed.filter("n_shingles = 0").select("doc_id", "n_shingles")
    if repeated is None:
        bare = bare.withColumn("component_id", F.col("doc_id"))
    else:
        bare = bare.join(comps, F.col("doc_id") == F.col("node"), "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    rows = rows.unionByName(bare).withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = source.filter("doc_id IS NULL").mapInPandas(_sign, SIGNED)
    return rows.unionByName(nameless.select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of every component, with all columns; rows without id stay.

    Of several rows of the id that stays, the one with the least text is taken (null first), then the least of the other
    columns written as JSON, so that a task that is run again takes the same one.
    """
    found = materialise(near_duplicates(docs).select("doc_id", "kept"), "verdicts")
    marked = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("marked_id")).agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    marked = materialise(marked.filter("NOT stays OR rows > 1"), "marked")
    plain, others = split_by_ids(docs, "doc_id", marked, "marked_id")  # most rows are the only ones of ids that stay: their texts are not moved
    once = plain.unionByName(others.join(marked, others["doc_id"] == marked["marked_id"], "left_anti"))
    repeated = marked.filter("stays")
    if repeated.isEmpty():
        return once
    again = others.join(repeated, others["doc_id"] == repeated["marked_id"], "left_semi")
    order = F.struct(F.col("text"), F.to_json(F.struct(*[c for c in docs.columns if c != "text"])))
    again = again.groupBy("doc_id").agg(F.min_by(F.struct("*"), order).alias("row")).select("row.*")
    return once.unionByName(again)


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
