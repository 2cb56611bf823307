"""Near-duplicate documents by a chosen-path set similarity join.

A document is its set of word shingles.  ``K`` minwise tokens (position, minimum)
stand for the set.  A tree starts with all sets in one node; a set moves to the
child of a token when a hash of (path, token) falls under a threshold, which gives
``branching`` children per set and node on average.  Two sets of similarity ``s``
share ``branching * s`` of those children on average, unlike sets none, so nodes become
small by themselves.  Members of a node of at most ``node_limit`` sets are compared
exhaustively by sketch; larger nodes branch further, up to ``max_depth``, and a node
that is still larger there (copies of one text) is cut into blocks: each meets itself and the
first, then what is not in the node's largest component so far meets every block, so each pair
is compared or linked already.  Independent trees repeat this until a linked pair meets with
probability ``recall``.

What the nodes yield is a loose forest (sketch similarity above a cut that a linked
pair misses about once in 10^4).  Its components are then searched with the full shingle
sets: breadth-first, each set against those not reached yet, so a component of near
copies is never expanded into its pairs.  Links are confirmed in integers, as
``100 * intersection >= percent * union``.

Identical sets collapse to the smallest id first; a group of copies is one row.

Nulls and empty texts have no shingles: they are linked with nothing and are their own
component.  Rows of one id count as one document with the union of their links, whether their texts are equal or
not.  Rows with a null id are documents of their own where their texts differ: another document's id stays before theirs,
and of a component of null ids alone the text with the smallest hash stays (all rows of it), with a null component_id.
An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.llm.scratch import numbered, written
from cityhop.llm.words import WORD_PATTERN, batch_shingles, chunks, mix
from cityhop.operators.cluster import connected_components

K = 64
#: Members of a component, and shingles of theirs, that one task searches with their full sets (about).
BLOCK = 4096
SHINGLES = 4_000_000
#: Rows of a checked size that may be broadcast (two longs each).
BROADCAST_ROWS = 200_000
_rng = np.random.default_rng(77)
_A = _rng.integers(1, 2**62, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = mix(np.arange(1, K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_ONES = np.uint64(0x1111111111111111)


def trees_for(recall: float, depth: int, branching: float, percent: int = 100) -> int:
    """Trees after which a pair at the threshold has met on level ``depth`` with probability ``recall``.

    Of the K minima of a pair, a binomial number agree; these are the same on all levels and in all
    trees, and each is chosen by a node with probability ``branching / K``.
    """
    s = percent / 100
    agreeing = [(math.comb(K, a) * s**a * (1 - s) ** (K - a), a) for a in range(K + 1)]
    miss = []
    for _, a in agreeing:
        meet = 1.0
        for _ in range(depth):
            meet = 1 - (1 - branching / K * meet) ** a
        miss.append(1 - meet)
    trees = 1
    while sum(p * m**trees for (p, _), m in zip(agreeing, miss)) > 1 - recall:
        trees += 1
    return trees


def _sketch(minima: np.ndarray) -> np.ndarray:
    """Four bits of each minimum: 4 words of 16 nibbles."""
    nibble = (mix(minima) & np.uint64(15)).reshape(-1, 4, 16)
    return (nibble << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def _agreeing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    x = x | (x >> np.uint64(1))
    x = (x | (x >> np.uint64(2))) & _ONES
    return K - np.bitwise_count(x).sum(axis=1, dtype=np.int64)


def _agree_cut(percent: int) -> int:
    """Agreeing nibbles that a pair at the threshold falls short of about once in 10^4."""
    p = percent / 100 + (1 - percent / 100) / 16
    return max(1, math.floor(K * p - 3.8 * math.sqrt(K * p * (1 - p))))


def _features(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts):
                values, bounds = batch_shingles(texts[a:b], width)
                rows = []
                for i, (p, q) in enumerate(zip(bounds[:-1], bounds[1:])):
                    s = values[p:q]
                    if len(s):
                        low = np.full(K, np.iinfo(np.uint64).max, np.uint64)
                        for c in range(0, len(s), 1 << 14):
                            part = s[c : c + (1 << 14), None] * _A[None, :]
                            np.minimum(low, part.min(axis=0), out=low)
                        d1, d2 = int(s.sum(dtype=np.uint64)), int(mix(s ^ _PLACE[0]).sum(dtype=np.uint64))
                    else:
                        low, d1, d2 = np.zeros(K, np.uint64), 0, 0
                    rows.append((len(s), d1 - (1 << 63), d2 - (1 << 63), low.tobytes() if len(s) else b""))
                out = pd.DataFrame(rows, columns=["n", "d1", "d2", "minima"])
                out.insert(0, "id", pdf["id"].to_numpy()[a:b])
                yield out

    return run


def _minima(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, K)


def _children(minima: np.ndarray, path: np.ndarray, branching: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child key) of every token of a row that its node chooses."""
    token = mix(minima + _PLACE)
    draw = mix(token ^ path[:, None])
    row, place = np.nonzero(draw < np.uint64(int(branching / K * 2**64)))
    return row, mix(draw[row, place] + token[row, place])


def _roots(trees: int, branching: float):
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                yield from _node_rows(part, [np.full(len(part), s, np.uint64) for s in seeds], branching)

    return run


def _branches(branching: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 4096):
                part = pdf.iloc[at : at + 4096]
                yield from _node_rows(part, [part["key"].to_numpy().view(np.uint64)], branching)

    return run


def _node_rows(part: pd.DataFrame, paths: list[np.ndarray], branching: float) -> Iterator[pd.DataFrame]:
    minima = _minima(part["minima"])
    found = [_children(minima, p, branching) for p in paths]
    row = np.concatenate([r for r, _ in found])
    key = np.concatenate([k for _, k in found])
    s = _sketch(minima)[row].view(np.int64)
    yield pd.DataFrame(
        {"key": key.view(np.int64), "id": part["id"].to_numpy()[row], "n": part["n"].to_numpy()[row], "s0": s[:, 0], "s1": s[:, 1], "s2": s[:, 2], "s3": s[:, 3]}
    )


def _reach(sketch: np.ndarray, n: np.ndarray, cut: int, percent: int, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning links of a node: breadth-first, each member against those not reached yet.

    Members of one ``label`` are linked already.
    """
    rest = np.arange(len(n))
    label = rest if label is None else label
    links = []
    while len(rest) > 1:
        same = label[rest] == label[rest[0]]
        queue, rest = rest[same].tolist(), rest[~same]
        while queue and len(rest):
            x = queue.pop()
            like = _agreeing(sketch[x], sketch[rest]) >= cut
            like &= 100 * np.minimum(n[rest], n[x]) >= percent * np.maximum(n[rest], n[x])
            hit = rest[like]
            if len(hit):
                links += [(int(x), int(y)) for y in hit]
                same = np.isin(label[rest], label[hit])
                queue += rest[same].tolist()
                rest = rest[~same]
    return links


def _nodes(limit: int, cut: int, percent: int):
    """Over rows sorted by key: links of small nodes, and the rows of large ones."""

    def small(rows: list[np.ndarray]) -> list[tuple[int, int, int, bool]]:
        x = np.concatenate(rows)
        return [(0, int(x[a, 1]), int(x[b, 1]), False) for a, b in _reach(x[:, 3:].view(np.uint64), x[:, 2], cut, percent)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size, key, large = 0, None, False
        out: list[tuple[int, int, int, bool]] = []

        def close() -> None:
            if size > 1 and not large:
                out.extend(small(held))

        for pdf in batches:
            x = np.ascontiguousarray(pdf.to_numpy(np.int64))
            if not len(x):
                continue
            cuts = np.flatnonzero(np.diff(x[:, 0])) + 1
            edges = np.concatenate([[0], cuts, [len(x)]])
            lengths = np.diff(edges)
            # only the first, the last and those of two rows or more can matter
            ends = len(lengths) - 1
            for g in np.flatnonzero((lengths > 1) | (np.arange(ends + 1) == 0) | (np.arange(ends + 1) == ends)):
                part = x[edges[g] : edges[g + 1]]
                if part[0, 0] != key:
                    close()
                    held, size, key, large = [], 0, part[0, 0], False
                for at in range(0, len(part), limit):
                    piece = part[at : at + limit]
                    size += len(piece)
                    if large or size > limit:
                        rows = [*held, piece] if not large else [piece]
                        large, held = True, []
                        out.extend((int(k), int(i), 0, True) for r in rows for k, i in r[:, :2])
                    else:
                        held.append(piece)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["key", "a", "b", "large"])
                out = []
        close()
        if out:
            yield pd.DataFrame(out, columns=["key", "a", "b", "large"])

    return run


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        s = _sketch(_minima(pdf["minima"])).view(np.int64)
        yield pd.DataFrame({"id": pdf["id"], "n": pdf["n"], "s0": s[:, 0], "s1": s[:, 1], "s2": s[:, 2], "s3": s[:, 3]})


def _blocks(cut: int, percent: int):
    """Over rows sorted by task: spanning links of each task's rows by sketch; rows of one label count as linked."""

    def links(x: np.ndarray) -> list[tuple[int, int]]:
        label, ids = x[:, 2], x[:, 3]
        sketch, n = np.ascontiguousarray(x[:, 5:]).view(np.uint64), x[:, 4]
        return [(int(ids[a]), int(ids[b])) for a, b in _reach(sketch, n, cut, percent, label)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        out: list[tuple[int, int]] = []
        for pdf in batches:
            x = pdf.to_numpy(np.int64)
            if not len(x):
                continue
            edges = [0, *(np.flatnonzero(np.any(np.diff(x[:, :2], axis=0) != 0, axis=1)) + 1), len(x)]
            for a, b in zip(edges[:-1], edges[1:]):
                if held and tuple(held[0][0, :2]) != tuple(x[a, :2]):
                    out += links(np.concatenate(held))
                    held = []
                held.append(x[a:b])
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if held:
            out += links(np.concatenate(held))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _large_links(large: DataFrame, reps: DataFrame, edges: DataFrame, limit: int, cut: int, percent: int) -> DataFrame:
    """Loose links of nodes that stayed large, with ``edges`` as what is linked already.

    First every block of a node meets itself and block 0; then what is not in a node's largest
    component so far meets every block, so no pair of unlike components goes uncompared.
    """
    sketches = written(reps.mapInPandas(_sketches, "id long, n long, s0 long, s1 long, s2 long, s3 long"))
    sizes = written(large.groupBy(F.col("key").alias("cluster")).agg(F.ceil(F.count(F.lit(1)) / limit).cast("int").alias("blocks")))
    few = sizes.count() <= BROADCAST_ROWS
    nodes = written(
        large.select(F.col("key").alias("cluster"), "id")
        .join(F.broadcast(sizes) if few else sizes, "cluster")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )

    def found(tasks: DataFrame) -> DataFrame:
        rows = tasks.join(sketches, "id").select("cluster", F.col("task").cast("long").alias("task"), "label", "id", "n", "s0", "s1", "s2", "s3")
        return rows.repartition("cluster", "task").sortWithinPartitions("cluster", "task").mapInPandas(_blocks(cut, percent), "a long, b long")

    edges = edges.unionByName(written(found(_first_tasks(nodes))))
    loose = written(connected_components(edges))
    known = written(
        nodes.join(loose, nodes["id"] == loose["node"], "left").select("cluster", "blocks", "block", "id", F.coalesce("label", "id").alias("label"))
    )
    far = written(found(_rest_tasks(known, limit)))
    return loose.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(far)


class _Sets:
    """Shingle sets of a group in one array of small token numbers."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.n = np.diff(bounds)
        _, token = np.unique(values, return_inverse=True)
        self.token, self.bounds = token, bounds
        self.mark = np.zeros(int(token.max()) + 1 if len(token) else 1, bool)

    def linked(self, x: int, others: np.ndarray, percent: int) -> np.ndarray:
        """Which of ``others`` are linked with ``x``."""
        fits = 100 * np.minimum(self.n[others], self.n[x]) >= percent * np.maximum(self.n[others], self.n[x])
        fits &= self.n[others] > 0
        some = others[fits]
        if not len(some) or not self.n[x]:
            return np.zeros(len(others), bool)
        mine = self.token[self.bounds[x] : self.bounds[x + 1]]
        self.mark[mine] = True
        n = self.n[some]
        ends = np.cumsum(n)
        index = np.arange(ends[-1]) + np.repeat(self.bounds[some] - (ends - n), n)
        same = np.add.reduceat(self.mark[self.token[index]].astype(np.int64), ends - n)
        self.mark[mine] = False
        out = np.zeros(len(others), bool)
        out[fits] = 100 * same >= percent * (n + self.n[x] - same)
        return out


def _confirm(width: int, percent: int):
    """Rows sorted by task: spanning links of each task's documents, confirmed on full sets.

    ``label`` holds what is known to be linked already; only documents of unlike labels are compared.
    """

    def links(pdf: pd.DataFrame) -> list[tuple[int, int]]:
        pdf = pdf.drop_duplicates("id")
        ids, label = pdf["id"].to_numpy(), pdf["label"].to_numpy()
        sets = _Sets(*batch_shingles(pdf["text"].tolist(), width))
        rest = np.arange(len(ids))
        out = []
        while len(rest) > 1:
            same = label[rest] == label[rest[0]]
            queue, rest = rest[same].tolist(), rest[~same]
            while queue and len(rest):
                x = queue.pop()
                hit = rest[sets.linked(x, rest, percent)]
                if len(hit):
                    out += [(int(ids[x]), int(ids[y])) for y in hit]
                    same = np.isin(label[rest], label[hit])
                    queue += rest[same].tolist()
                    rest = rest[~same]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        out: list[tuple[int, int]] = []
        for pdf in batches:
            if not len(pdf):
                continue
            cuts = np.flatnonzero(np.any(np.diff(pdf[["cluster", "task"]].to_numpy(np.int64), axis=0) != 0, axis=1)) + 1
            edges = [0, *cuts, len(pdf)]
            for a, b in zip(edges[:-1], edges[1:]):
                part = pdf.iloc[a:b]
                if held and tuple(held[0][["cluster", "task"]].iloc[0]) != tuple(part[["cluster", "task"]].iloc[0]):
                    out += links(pd.concat(held))
                    held = []
                held.append(part)
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if held:
            out += links(pd.concat(held))
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _with_texts(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Members (id, ...) with their texts; broadcast only if they were counted to be few."""
    few = members.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(members) if few else members, "id")


def _links_in(docs: DataFrame, tasks: DataFrame, width: int, percent: int) -> DataFrame:
    rows = _with_texts(docs, tasks).select("cluster", "task", "label", "id", "text")
    return rows.repartition("cluster", "task").sortWithinPartitions("cluster", "task", "id").mapInPandas(_confirm(width, percent), "a long, b long")


def _components(
    docs: DataFrame, together: DataFrame | None, width: int, percent: int, recall: float, branching: float, node_limit: int, max_depth: int
) -> DataFrame:
    """id, n, component (smallest id that links reach) for ``docs``: id (each once, not null), text.

    ``together``: pairs (a, b) of ids that are linked whatever their texts.
    """
    cut = _agree_cut(percent)
    feats = written(docs.select("id", "text").mapInPandas(_features(width), "id long, n long, d1 long, d2 long, minima binary"))
    full = feats.where("n > 0")
    firsts = full.groupBy("n", "d1", "d2").agg(F.min("id").alias("rep"))
    classes = written(feats.select("id", "n", "d1", "d2").join(firsts, ["n", "d1", "d2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep")))
    reps = full.join(firsts.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").select("id", "n", "minima")

    trees = trees_for(recall, max_depth, branching, percent)
    schema = "key long, id long, n long, s0 long, s1 long, s2 long, s3 long"
    level = reps.mapInPandas(_roots(trees, branching), schema)
    edges = None
    for depth in range(1, max_depth + 1):
        found = written(
            level.repartition("key")
            .sortWithinPartitions("key")
            .mapInPandas(_nodes(node_limit, cut, percent), "key long, a long, b long, large boolean")
        )
        links = found.where("not large").select("a", "b")
        edges = links if edges is None else edges.unionByName(links)
        large = found.where("large").select("key", F.col("a").alias("id"))
        if large.isEmpty():
            break
        if depth == max_depth:
            edges = _large_links(large, reps, edges, node_limit, cut, percent)
            break
        level = large.join(reps, "id").select("key", "id", "n", "minima").mapInPandas(_branches(branching), schema)

    loose = written(connected_components(edges))  # node, label
    sized = loose.join(reps.select(F.col("id").alias("node"), "n"), "node")
    blocks = F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("n") / SHINGLES)).cast("int")
    sizes = sized.groupBy(F.col("label").alias("cluster")).agg(blocks.alias("blocks"))
    members = written(
        loose.join(sizes, loose["label"] == sizes["cluster"])
        .select(F.col("node").alias("id"), "cluster", "blocks")
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    )
    links = written(_links_in(docs, _first_tasks(members), width, percent))
    split = members.where("blocks > 1")
    if not split.isEmpty():
        links = written(links.unionByName(_rest_links(docs, split, links, width, percent)))
    if together is not None:
        reps_of = classes.select("id", "rep")
        a, b = (reps_of.select(F.col("id").alias(c), F.col("rep").alias(f"rep_{c}")) for c in ("a", "b"))
        links = links.unionByName(together.join(a, "a").join(b, "b").where("rep_a <> rep_b").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b")))
    labels = connected_components(links)
    joined = classes.join(labels, classes["rep"] == labels["node"], "left")
    return joined.select("id", "n", F.coalesce("label", "rep").alias("component"))


def near_rows(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    percent: int = 80,
    recall: float = 0.999,
    branching: float = 1.45,
    node_limit: int = 2048,
    max_depth: int = 3,
) -> DataFrame:
    """One row per distinct row (id, hash of the text): doc, th, n_shingles, component (smallest id that links reach), stays."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    options = (width, percent, recall, branching, node_limit, max_depth)
    if docs.groupBy("doc").count().where("count > 1 or doc is null").isEmpty():
        found = _components(docs.withColumnRenamed("doc", "id"), None, *options)
        named = found.select(F.col("id").alias("doc"), F.col("n").alias("n_shingles"), "component")
        return named.join(docs.select("doc", "th"), "doc").select("doc", "th", "n_shingles", "component", (F.col("doc") == F.col("component")).alias("stays"))
    # number the distinct rows through, null ids after all others
    rows = docs.withColumn("key", F.coalesce("doc", F.lit(2**63 - 1)))
    numbers = written(numbered(rows.select("key", "th", F.col("doc").isNull().alias("blank")).distinct(), ["key", "blank", "th"]))
    texts = written(rows.withColumn("blank", F.col("doc").isNull()).join(numbers, ["key", "blank", "th"]).groupBy(F.col("number").alias("id")).agg(F.first("text").alias("text")))
    own = numbers.where("not blank").groupBy("key").agg(F.min("number").alias("a"))
    together = written(numbers.where("not blank").join(own, "key").where("number <> a").select("a", F.col("number").alias("b")))
    # an empty text is linked with nothing, also not with its id's other texts
    worded = texts.where(F.col("text").rlike(WORD_PATTERN)).select("id")
    together = together.join(worded.withColumnRenamed("id", "b"), "b", "left_semi")
    found = written(_components(texts, together, *options))
    names = numbers.select(F.col("number").alias("component"), F.col("key").alias("to_key"), F.col("blank").alias("to_blank"))
    told = numbers.join(found, numbers["number"] == found["id"]).join(names, "component")
    doc = F.when(~F.col("blank"), F.col("key"))
    to = F.when(~F.col("to_blank"), F.col("to_key"))
    stays = F.when(to.isNull(), F.col("number") == F.col("component")).otherwise(doc.eqNullSafe(to))
    return told.select(doc.alias("doc"), "th", F.col("n").alias("n_shingles"), to.alias("component"), stays.alias("stays"))


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, **options) -> DataFrame:
    """One row per document: id, n_shingles, component_id (smallest id that links reach), kept; options as of ``near_rows``."""
    rows = near_rows(documents, id_col, text_col, width, percent, **options)
    # of rows with an id one row in all, of rows without one per text
    of = rows.groupBy("doc", F.when(F.col("doc").isNull(), F.col("th")).alias("own"))
    out = of.agg(F.max("n_shingles").alias("n_shingles"), F.min("component").alias("component_id"), F.max("stays").alias("stays"))
    kept = F.when(F.col("doc").isNull(), F.col("stays")).otherwise(F.col("doc") == F.col("component_id"))
    return out.select(F.col("doc").alias(id_col), "n_shingles", "component_id", kept.alias("kept"))


def _first_tasks(members: DataFrame) -> DataFrame:
    """Tasks (cluster, task, label, id) in which every block of a cluster meets itself and block 0."""
    others = F.sequence(F.lit(1), F.col("blocks") - 1)
    task = F.explode(F.when((F.col("block") == 0) & (F.col("blocks") > 1), others).otherwise(F.array("block"))).alias("task")
    return members.select("cluster", task, F.col("id").alias("label"), "id")


def _rest_tasks(known: DataFrame, size: int) -> DataFrame:
    """Tasks in which what is not in a cluster's largest component meets every block, ``size`` at a time.

    Pairs inside the largest component need no comparison, and all others have a member here, so
    nothing is lost; the work is that of the rest times the cluster, in blocks.
    """
    counts = known.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c"))
    top = counts.groupBy("cluster").agg(F.max_by("label", F.struct("c", "label")).alias("top"))
    rest = known.join(top, "cluster").where("label <> top").select("cluster", "blocks", "id", "label")
    parts = rest.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("parts"))
    rest = written(rest.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int")))
    number = (F.col("part") * F.col("blocks") + F.col("block")).alias("task")
    left = rest.select("cluster", "part", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "id", "label").select("cluster", number, "label", "id")
    right = known.join(parts, "cluster").select("cluster", "blocks", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", "label").select("cluster", number, "label", "id")
    return left.unionByName(right).distinct()


def _rest_links(docs: DataFrame, split: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame:
    """Links of clusters of several blocks that the first tasks could not see."""
    labels = connected_components(links)
    known = written(
        split.join(labels, split["id"] == labels["node"], "left").select("cluster", "blocks", "block", "id", F.coalesce("label", "id").alias("label"))
    )
    return _links_in(docs, _rest_tasks(known, BLOCK), width, percent)
