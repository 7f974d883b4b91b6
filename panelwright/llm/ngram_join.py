"""N-gram Jaccard join: all pairs of documents whose sets of five-word shingles have a similarity of 0.8 or more.

The method is a MinHash LSH forest. Each of `TREES` trees labels a document with `DEEPEST` MinHash values; sorted by label, a tree is a prefix
trie, and documents below one node share the prefix that leads to it. The join starts at the deepest nodes, where nearly all that meet
are similar, and verifies the pairs found there exactly. From the similarities found it estimates, for each band of similarity, which share of
the pairs met in some tree at that depth; while a band falls short of the target recall, matched prefixes are shortened, to the
greatest depth at which the bands found would reach it, and the pairs that are new there are verified. So data whose copies are close to each
other never pay for short prefixes, and data with pairs near the threshold get them. The shortest prefix, `shortest_depth`, is the one at which a pair right
at the threshold still meets with the target recall.

At scale: documents with one shingle set are one member with a weight, so exact copies never form pairs. Members that no tree holds together at the shortest
prefix are set aside first, by one aggregation; the trie is built of the rest. A node whose members a deeper node has together already
holds no new pair, and of nodes with the same members one is taken. A large node is cut into blocks, and each pair of blocks is one
unit of verification: no task holds more than two blocks. A pair that several trees hold together is verified and counted in the first of them
only. A unit returns one row for each member, with its number of links and a spanning forest, never all pairs.

Words are runs of letters and digits with A-Z lower-cased. A text of one to four words is one shingle. Null and empty texts, and
those without a word, have no shingle, no link and a class of their own. Rows alike in doc_id and text are copies of each other. An
empty table gives an empty result. Null doc_ids stay; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import WORD_HASHES, byte_texts, folded_words, gram_hashes, mixed, passing, row_key, saved, signed
from panelwright.llm.components import connected_components

SHINGLE, THRESHOLD, TREES, DEEPEST, RECALL = 5, 0.8, 20, 10, 0.9995
#: Members of a block, and shingles of all its members together.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Bands of similarity for which recall is estimated, from the threshold up to 1.
BANDS = 20


def met(similarity, depth: int, trees: int = TREES):
    """Probability that a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def shortest_depth(threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int:
    """The greatest depth at which a pair right at the threshold meets with the target recall."""
    return max([d for d in range(1, deepest + 1) if met(threshold, d, trees) >= recall], default=1)


def next_depth(found: dict[int, int], depth: int, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL) -> int | None:
    """The depth to shorten prefixes to, None when there is no need: found has the number of pairs of each band verified down to `depth`.

    A band with k pairs found of a probability p to meet is taken to hold k / p of them, so its recall is p at its least similarity.
    Bands without a pair count as empty, which a depth has to show with a probability of 0.9 at the threshold.
    """
    width, least = (1 - threshold) / BANDS, shortest_depth(threshold, trees, deepest, recall)
    lows = [threshold + width * band for band, k in found.items() if k]
    fits = lambda d: met(threshold, d, trees) >= 0.9 and all(met(low, d, trees) >= recall for low in lows)
    goal = next((d for d in range(deepest, least, -1) if fits(d)), least)
    return goal if goal < depth else None


def shingle_set(text: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles."""
    words = folded_words(text)
    return np.unique(gram_hashes(WORD_HASHES.array(words), min(n, len(words)))) if words else np.zeros(0, dtype=np.uint64)


def label(shingles: np.ndarray, multipliers: np.ndarray) -> bytes:
    """The MinHash values of all trees one after the other, each folded to two bytes: values that are alike stay alike."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(multipliers), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(short), 128):
        np.minimum(least, (short[at : at + 128, None] * multipliers).min(axis=0), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype("<u2").tobytes()


def signatures(docs: DataFrame, trees: int = TREES, deepest: int = DEEPEST, n: int = SHINGLE) -> DataFrame:
    """doc_id, r (row key), a and b (128 bits of the shingle set), size, label (all trees, null without shingles)."""
    multipliers = (mixed(np.arange(1, trees * deepest + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)

    def sign(batches):
        for batch in batches:
            a, b, size, labels = [], [], [], []
            for text in byte_texts(batch["text"]):
                s = shingle_set(text, n)
                a.append(int(mixed(s).sum(dtype=np.uint64).view(np.int64)))
                b.append(int(mixed(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).view(np.int64)))
                size.append(len(s))
                labels.append(label(s, multipliers) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["r"], pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(size, pa.int64()), pa.array(labels, pa.binary())],
                names=["doc_id", "r", "a", "b", "size", "label"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", row_key().alias("r")).mapInArrow(sign, f"doc_id {kind}, r long, a long, b long, size long, label binary")


def _prefixes(labels: np.ndarray, depth: int) -> np.ndarray:
    """A number for each member and tree, the same for members that share the prefix of this depth there."""
    return np.stack([np.unique(np.ascontiguousarray(labels[:, t, :depth]).view(f"V{2 * depth}").ravel(), return_inverse=True)[1] for t in range(labels.shape[1])], axis=1)


def _new_pairs(labels: np.ndarray, tree: int, depth: int, before: int | None) -> np.ndarray:
    """Which pairs of members are verified in this tree: no earlier tree has them together at this depth, and no tree at the depth before."""
    own = _prefixes(labels, depth)
    fresh = own[:, tree, None] == own[None, :, tree]
    for t in range(tree):
        fresh &= own[:, t, None] != own[None, :, t]
    if before is not None:
        deeper = _prefixes(labels, before)
        for t in range(labels.shape[1]):
            fresh &= deeper[:, t, None] != deeper[None, :, t]
    np.fill_diagonal(fresh, False)
    return fresh


def _verified(members: list[tuple], lo: int, hi: int, tree: int, depth: int, before: int | None, threshold: float, trees: int, n: int):
    """((member, linked documents, member to join with) ..., pairs by band) of one unit: all pairs of a block, or between two blocks."""
    seen = {m: (block, weight, sign, text) for m, block, weight, sign, text in members}
    names = np.array(sorted(seen), dtype=np.int64)
    labels = np.frombuffer(b"".join(seen[m][2] for m in names.tolist()), dtype="<u2").reshape(len(names), trees, -1)
    fresh = _new_pairs(labels, tree, depth, before)
    if lo != hi:
        blocks = np.array([seen[m][0] for m in names.tolist()])
        fresh &= blocks[:, None] != blocks[None, :]
    some = fresh.any(axis=1)
    if not some.any():
        return [], {}
    names, fresh = names[some], fresh[np.ix_(some, some)]
    sets = [shingle_set(seen[m][3], n) for m in names.tolist()]
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    weights = np.array([seen[m][1] for m in names.tolist()], dtype=np.int64)
    values, index = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(names)), [len(s) for s in sets])
    shared = np.bincount(index, minlength=len(values)) > 1
    index, owner = (np.cumsum(shared) - 1)[index[shared[index]]], owner[shared[index]]
    common = np.zeros((len(names), len(names)), dtype=np.float32)
    order = np.argsort(index, kind="stable")
    index, owner = index[order], owner[order]
    for low in range(0, int(shared.sum()), 2048):
        from_, to = np.searchsorted(index, [low, low + 2048])
        part = np.zeros((len(names), min(2048, int(shared.sum()) - low)), dtype=np.float32)
        part[owner[from_:to], index[from_:to] - low] = 1
        common += part @ part.T
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= threshold * union - 1e-6) & fresh
    counts = linked @ weights
    upper = np.triu(linked)
    bands = np.minimum(BANDS - 1, ((common[upper] / union[upper] - threshold) / (1 - threshold) * BANDS + 1e-6).astype(np.int64))
    # A spanning forest: each member names the first member of its part.
    root = np.arange(len(names))
    while True:
        least = np.minimum(root, np.where(linked, root[None, :], len(names)).min(axis=1))[root]
        least = least[least]
        if (least == root).all():
            break
        root = least
    kinds, number = np.unique(bands, return_counts=True)
    return [(int(names[i]), int(counts[i]), int(names[root[i]])) for i in np.flatnonzero(counts).tolist()], dict(zip(kinds.tolist(), number.tolist()))


def _nodes(meeting: DataFrame, depth: int, before: int | None, block: int, shingles: int) -> DataFrame:
    """tree, member, node, blocks of the trie nodes at this depth that may hold a new pair; meeting: tree, path (label in the tree), member, size."""
    node = F.xxhash64("tree", F.substring("path", 1, 2 * depth))
    placed = meeting.withColumn("node", node)
    child = F.xxhash64("tree", F.substring("path", 1, 2 * before)) if before else F.xxhash64("member")
    seen = placed.groupBy("tree", "node").agg(F.count("*").alias("k"), F.sum("size").alias("s"), F.min(child).alias("low"), F.max(child).alias("high"), F.bit_xor(F.xxhash64("member", F.lit(1))).alias("who"))
    # Of nodes with the same members (their number and the hash of all of them) the one of the first tree.
    one = seen.filter("low <> high").groupBy("k", "who").agg(F.min(F.struct("tree", "node", "s")).alias("one")).select("k", "one.*")
    blocks = F.ceil(F.greatest(F.col("k") / block, F.col("s") / shingles)).cast("int")
    return placed.select("tree", "node", "member").join(one.select("tree", "node", blocks.alias("blocks")), ["tree", "node"])


def links(docs: DataFrame, threshold: float = THRESHOLD, trees: int = TREES, deepest: int = DEEPEST, recall: float = RECALL, block: int = BLOCK, n: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Signed documents, and for each shingle set with a link: member, n (linked documents with other sets), component."""
    signed_docs = saved(signatures(docs, trees, deepest, n), "signatures")
    sets = signed_docs.filter("size > 0").groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("r").alias("member"), F.first("label").alias("label"), F.first("size").alias("size"))
    sets = saved(sets, "sets")
    least = shortest_depth(threshold, trees, deepest, recall)
    path = F.substring(F.col("label"), F.col("tree") * F.lit(2 * deepest) + 1, F.lit(2 * deepest))
    paths = sets.select("member", "size", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), "label").select("member", "size", "tree", path.alias("path"))
    root = F.xxhash64("tree", F.substring("path", 1, 2 * least))
    # Roots that more than one member has: from here on only what meets somewhere is looked at.
    shared = paths.select(root.alias("root")).groupBy("root").agg(F.count("*").alias("k")).filter("k > 1").select("root")
    meeting = saved(paths.withColumn("root", root).join(shared, "root", "left_semi").select("tree", "path", "member", "size"), "meeting")
    wanted = saved(meeting.select("member").distinct().join(sets.select("member", "weight", "label"), "member"), "members")
    texts = passing(docs.select(row_key().alias("member"), "text"), wanted, "member").groupBy("member").agg(F.first("text").alias("text"))
    texts = saved(texts.join(wanted, "member"), "texts")

    depth, before, parts, found = next_depth({}, deepest + 1, threshold, trees, deepest, recall), None, [], {}
    while depth is not None:
        nodes = _nodes(meeting, depth, before, block, BLOCK_SHINGLES)
        part = saved(_unit_results(texts, nodes, depth, before, threshold, trees, n), "links")
        parts.append(part)
        for row in part.filter("band is not null").groupBy("band").agg(F.sum("n").alias("n")).collect():
            found[row.band] = found.get(row.band, 0) + row.n
        depth, before = next_depth(found, depth, threshold, trees, deepest, recall), depth
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.unionByName(part)
    pairs = pairs.filter("band is null")
    counts = pairs.groupBy("u").agg(F.sum("n").alias("n"))
    return signed_docs, connected_components(pairs.select("u", "v")).join(counts, F.col("node") == F.col("u"), "left").select(F.col("node").alias("member"), "component", F.coalesce("n", F.lit(0)).alias("n"))


def _unit_results(texts: DataFrame, nodes: DataFrame, depth: int, before: int | None, threshold: float, trees: int, n: int) -> DataFrame:
    """u, n, v for the members with links in each unit, and rows with the number n of linked pairs of a band."""
    own = F.pmod(F.xxhash64(F.col("member"), F.lit(7)), F.col("blocks")).cast("int")
    places = nodes.groupBy("member").agg(F.collect_list(F.struct("tree", "node", "blocks", own.alias("block"))).alias("places"))  # one for each tree at most
    spread = texts.join(places, "member").select("member", "weight", "label", "text", F.explode("places").alias("at")).select("member", "weight", "label", "text", "at.*")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = spread.withColumn("other", other).withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")}).drop("other", "blocks")

    def rows(batches):
        for batch in batches:
            yield from zip(*(batch[c].to_pylist() for c in ("tree", "node", "lo", "hi", "member", "block", "weight", "label")), byte_texts(batch["text"]))

    def verify(batches):
        for (tree, _, lo, hi), unit in groupby(rows(batches), key=lambda x: x[:4]):
            found, bands = _verified([x[4:] for x in unit], lo, hi, tree, depth, before, threshold, trees, n)
            out = [(u, k, v, None) for u, k, v in found] + [(None, k, None, band) for band, k in bands.items()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int32()))], names=["u", "n", "v", "band"])

    return units.repartition("tree", "node", "lo", "hi").sortWithinPartitions("tree", "node", "lo", "hi").mapInArrow(verify, "u long, n long, v long, band int")


def near_duplicate_classes(docs: DataFrame, **limits) -> DataFrame:
    """One row for each row of docs: doc_id, r (row key), component, class_id, copy_id, n_links.

    class_id is the least doc_id among the documents that links connect, copy_id the least with the same shingle set;
    n_links counts the other documents, copies included, whose similarity reaches the threshold.
    """
    signed_docs, linked = links(docs, **limits)
    sets = signed_docs.filter("size > 0").groupBy("a", "b").agg(F.count("*").alias("weight"), F.min("r").alias("member"), F.min("doc_id").alias("copy_id"))
    sets = saved(sets.join(linked, "member", "left").withColumn("component", F.coalesce("component", "member")), "classes")
    least = sets.groupBy("component").agg(F.min("copy_id").alias("class_id"))
    known = sets.join(least, "component").select("a", "b", "component", "class_id", "copy_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    both = signed_docs.filter("size > 0").select("doc_id", "r", "a", "b").join(known, ["a", "b"]).select("doc_id", "r", "component", "class_id", "copy_id", "n_links")
    alone = signed_docs.filter("size = 0").select("doc_id", "r", F.col("r").alias("component"), F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_id"), F.lit(0).cast("long").alias("n_links"))
    return both.unionByName(alone)


def keep_one_of_each(docs: DataFrame, **limits) -> DataFrame:
    """docs with one document of each class: the one with the least doc_id, and of several rows of it, the one whose columns have the least hash."""
    classes = near_duplicate_classes(docs, **limits)
    least = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "r"))
    keep = classes.groupBy("component").agg(least.alias("least")).select(F.col("least.r").alias("__r"))
    chosen = docs.withColumn("__r", row_key()).join(keep, "__r", "left_semi")
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    return chosen.groupBy("__r").agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("__one")).select("__one.*")
