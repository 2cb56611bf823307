"""Line deduplication by an exact set-similarity join.

A line is the set of its words (as in ``words``).  Two lines match when ``100 * intersection >= percent * union``; a line that matches an
earlier one (by document, then line number) is removed.

1. Words are counted over the whole corpus in 2**20 hash buckets (4 MB whatever the corpus).  Buckets are put in order of the logarithm of their
   counts; a word's place is its bucket's, then its hash: a total order of all words, rare ones first, that keeps all 64 bits of the hash.
2. Lines of equal sets collapse to the first; the others are removed.
3. Matching lines share a word among their first ``n - ceil(percent * n / 100) + 1`` words (prefix filter); words of a count of one cannot be shared.
   Lines meet by such words.  Pairs must pass the length filter, the positional filter (the words after the shared
   one must suffice) and a parity bitmap, whose difference bounds the intersection from above: all are exact, none drops a match.
4. Each line is verified on its full sets against the ``NEAREST`` candidates of each word group; lines that have more candidates
   and found no match go through all of theirs.  So a group of like lines is never expanded into its pairs.

A word group of more than ``GROUP`` lines is dealt as pairs of blocks, so that no task holds it whole.

Null and empty texts have one line without words; lines without words match nothing and stay.  A null id orders first.  Rows of equal id and
text are one document and get the same result; rows of equal id and unlike text are documents of their own, in order of their text's 64-bit hash:
where ids occur more than once, documents are numbered through in that order.  Extra columns are kept; the columns added get underscores
in front where the documents have their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityhop.llm.scratch import fresh, numbered, written
from cityhop.llm.words import chunks, mix, word_hashes

BUCKETS, PARTS = 1 << 20, 512
#: Candidates of a line in a word group that are verified first.
NEAREST = 4
#: Lines of a word group that one task compares.
GROUP = 1 << 15
#: Comparisons, and candidates found, that a task holds at once, about.
PAIRS = 1 << 19
#: Rows, and entries of their lists, up to which a table of line numbers is broadcast (28 MB); both are counted first.
BROADCAST_ROWS, BROADCAST_ENTRIES = 200_000, 2_000_000
_C = np.uint64(0x5851F42D4C957F2D)
_REST = np.uint64((1 << 44) - 1)
#: More than two bitmaps of 128 bits can differ by.
_APART = 129


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64)


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(BUCKETS, np.int64)
    for pdf in batches:
        texts = pdf["text"].tolist()
        for a, b in chunks(texts):
            _, h = word_hashes("\n".join(t or "" for t in texts[a:b]).encode("utf-8", "surrogatepass"))
            total += np.bincount(_bucket(h), minlength=BUCKETS)
    size = BUCKETS // PARTS
    yield pd.DataFrame({"part": range(PARTS), "counts": [total[k * size : (k + 1) * size].tobytes() for k in range(PARTS)]})


def _sum(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total: dict[int, np.ndarray] = {}
    for pdf in batches:
        for part, counts in zip(pdf["part"], pdf["counts"]):
            x = np.frombuffer(counts, np.int64)
            total[part] = total[part] + x if part in total else x
    for part, x in total.items():
        level = np.minimum(255, np.floor(8 * np.log2(np.maximum(x, 1)))).astype(np.uint8)
        yield pd.DataFrame({"part": [part], "levels": [level.tobytes()]})


def word_order(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Place of each bucket of words in order of the logarithm of its corpus count, and how many count no word twice."""
    counts = docs.select("text").mapInPandas(_count, "part int, counts binary")
    parts = counts.repartition("part").mapInPandas(_sum, "part int, levels binary")
    levels = np.zeros(BUCKETS, np.uint8)
    size = BUCKETS // PARTS
    for r in parts.collect():  # 1 MB in all
        levels[r["part"] * size : (r["part"] + 1) * size] = np.frombuffer(r["levels"], np.uint8)
    place = np.empty(BUCKETS, np.uint32)
    place[np.argsort(levels, kind="stable")] = np.arange(BUCKETS, dtype=np.uint32)
    return place, int((levels == 0).sum())


def _line_sets(texts: list[str], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of all lines in order, bounds of each line, first line of each text)."""
    data = "\n".join(texts).encode("utf-8", "surrogatepass")
    starts, h = word_hashes(data)
    feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 10)
    line = np.searchsorted(feeds, starts)
    word = (place[_bucket(h)].astype(np.uint64) << np.uint64(44)) | (h & _REST)
    bounds = np.searchsorted(line, np.arange(len(feeds) + 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a > 1:
            word[a:b].sort()
    new = np.ones(len(word), bool)
    new[1:] = (word[1:] != word[:-1]) | (line[1:] != line[:-1])
    kept = np.concatenate([[0], np.cumsum(new)])
    first = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([t.count("\n") + 1 for t in texts], out=first[1:])
    return word[new], kept[bounds], first


def _describe(order, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, singles = order.value
        once = np.uint64((singles << 44) % 2**64)
        for pdf in batches:
            texts = [t or "" for t in pdf["text"]]
            docs = pdf["doc"].to_numpy(np.int64)
            for a, b in chunks(texts, 1 << 21):
                word, bounds, first = _line_sets(texts[a:b], place)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                if not len(full):
                    continue
                at, size = bounds[:-1][full], n[full]
                text_of = np.searchsorted(first, full, side="right") - 1
                bit = word & np.uint64(127)
                one = np.uint64(1) << (bit & np.uint64(63))
                low = np.bitwise_xor.reduceat(np.where(bit < 64, one, np.uint64(0)), at)
                high = np.bitwise_xor.reduceat(np.where(bit < 64, np.uint64(0), one), at)
                unique = np.add.reduceat((word < once).astype(np.int64) if singles < BUCKETS else np.ones(len(word), np.int64), at)
                prefix = size + (-percent * size) // 100 + 1  # size - ceil(percent * size / 100) + 1
                # a set matches an unlike one only if it matches itself and one more
                prefix = np.where(100 * size >= percent * (size + 1), prefix, 0)
                skip = np.minimum(unique, prefix)
                yield pd.DataFrame(
                    {
                        "doc": docs[a:b][text_of],
                        "uid": full - first[text_of],
                        "n": size,
                        "skip": skip,
                        "d1": np.add.reduceat(mix(word), at).view(np.int64),
                        "d2": np.add.reduceat(mix(word ^ _C), at).view(np.int64),
                        "prefix": [word[i + s : i + p].tobytes() for i, s, p in zip(at, skip, prefix)],
                        "b1": low.view(np.int64),
                        "b2": high.view(np.int64),
                    }
                )

    return run


def _by_word(asked: np.ndarray | None = None):
    """A row for each word of a line's prefix, or for those that are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            prefix = rows.column("prefix")
            count = pc.binary_length(prefix).to_numpy(zero_copy_only=False) // 8
            row = np.repeat(np.arange(len(count)), count)
            word = np.frombuffer(b"".join(prefix.to_pylist()), np.int64)
            place = np.arange(len(word)) - np.repeat(np.cumsum(count) - count, count) + rows.column("skip").to_numpy()[row]
            if asked is not None:
                some = np.isin(word, asked)
                word, place, row = word[some], place[some], row[some]
            size = (rows.column("n").to_numpy()[row] << 32) | place
            rest = [c for c in rows.schema.names if c not in ("prefix", "skip", "n")]
            columns = [pa.array(rows.column(c).to_numpy(zero_copy_only=False)[row]) for c in rest]
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(size), *columns], ["word", "size", *rest])

    return run


#: ``size``: a line's number of words, times 2**32, and the word's place among them.
_COLUMNS = ["word", "block", "doc", "uid", "size", "b1", "b2", "side"]


def _meet(percent: int, nearest: int | None, limit: int):
    """Over rows sorted by word (and block): candidate pairs (later, earlier), and rows of word groups above ``limit``."""

    def pairs(x: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates in complete groups, each in order of length, about ``PAIRS`` comparisons at a time: later row, earlier row, distance."""
        c = {name: np.ascontiguousarray(x[:, k]) for k, name in enumerate(_COLUMNS)}
        c["b1"], c["b2"] = c["b1"].view(np.uint64), c["b2"].view(np.uint64)
        c["n"] = c["size"] >> 32
        c["place"] = c["size"] & 0xFFFFFFFF
        # the words from the shared one on must reach the least intersection: for either line this bounds the other's length
        size, slack = percent * c["n"], (100 + percent) * (c["n"] - c["place"]) - percent * c["n"]
        # each meets those behind it in its group, in order of their length, up to the first that is too long
        most = int(size.max()) + 1
        end = np.searchsorted(group * most + size, group * most + np.clip(np.minimum(100 * c["n"], slack), -1, most - 1), side="right")
        many = np.maximum(end - np.arange(len(x)) - 1, 0)
        upto = np.cumsum(many)
        first = 0
        while first < len(x):
            before = upto[first] - many[first]
            last = max(first + 1, int(np.searchsorted(upto, before + PAIRS, side="right")))
            a = np.repeat(np.arange(first, last), many[first:last])
            b = np.arange(len(a)) + before - (upto - many)[a] + a + 1
            first = last
            some = slack[b] >= size[a]
            a, b = a[some], b[some]
            need = -((-percent * (c["n"][a] + c["n"][b])) // (100 + percent))  # least intersection
            apart = np.bitwise_count(c["b1"][a] ^ c["b1"][b]).astype(np.int64) + np.bitwise_count(c["b2"][a] ^ c["b2"][b])
            near = c["n"][a] + c["n"][b] - 2 * need >= apart
            a, b, apart = a[near], b[near], apart[near]
            # side 0: any pair; 1 and 2: a pair of blocks; 3: a line that is looked for, 4: one of the others
            s, r = c["side"][a], c["side"][b]
            swap = (c["doc"][a] < c["doc"][b]) | ((c["doc"][a] == c["doc"][b]) & (c["uid"][a] < c["uid"][b]))
            later, earlier = np.where(swap, b, a), np.where(swap, a, b)
            fine = ((s == 0) | ((s != r) & (s < 3)) | (s == 3) | (r == 3)) & (c["side"][later] != 4)
            yield later[fine], earlier[fine], apart[fine]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pdf in met(batches):
            yield pa.RecordBatch.from_pandas(pdf[[f.split()[0] for f in _MET.split(", ")]], preserve_index=False)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        rows, large = 0, None

        def ranked(key: np.ndarray, of: np.ndarray) -> np.ndarray:
            """Place of each sorted key among those of its later line."""
            begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(key) else np.zeros(0, np.int64)
            return np.arange(len(key)) - np.repeat(begin, np.diff(np.append(begin, len(key))))

        def settle(x: np.ndarray) -> Iterator[pd.DataFrame]:
            """The candidates of each later line, or its nearest; no more than those and some comparisons are held."""
            group = np.zeros(len(x), np.int64)
            np.cumsum(np.any(x[1:, :2] != x[:-1, :2], axis=1), out=group[1:])
            x = x[np.lexsort((x[:, 4], group))]
            order = np.lexsort((x[:, 3], x[:, 2]))
            ids = x[order, 2:4]
            new = np.ones(len(x), bool)
            new[1:] = np.any(ids[1:] != ids[:-1], axis=1)
            ids, line = ids[new], np.empty(len(x), np.int64)
            line[order] = np.cumsum(new) - 1
            n = len(ids)
            best, found, size = np.zeros(0, np.int64), [], 0

            def chosen() -> np.ndarray:
                """Each pair once, by later line, distance, earlier line; of each later line one more than its nearest."""
                key = np.unique(np.concatenate([best, *found]))
                return key[ranked(key, key // (n * _APART)) <= nearest] if nearest else key

            def table(key: np.ndarray) -> pd.DataFrame:
                of = key // (n * _APART)
                rank = ranked(key, of)
                out = pd.DataFrame(np.concatenate([ids[of], ids[key % n]], axis=1), columns=["doc", "uid", "to_doc", "to_uid"])
                out["open"] = (np.bincount(of, minlength=n) > nearest)[of] if nearest else False
                out["word"], out["large"] = 0, False
                return out[rank < nearest] if nearest else out

            for later, earlier, apart in pairs(x, group):
                found.append((line[later] * _APART + apart) * n + line[earlier])
                size += len(later)
                if size >= PAIRS:
                    best, found, size = chosen(), [], 0
                    if not nearest:
                        yield table(best)
                        best = best[:0]
            best = chosen()
            if len(best):
                yield table(best)

        def spill(x: np.ndarray) -> pd.DataFrame:
            out = pd.DataFrame({"doc": x[:, 2], "uid": x[:, 3], "to_doc": 0, "to_uid": 0, "open": False, "word": x[:, 0], "large": True})
            return out

        def finish(x: np.ndarray) -> Iterator[pd.DataFrame]:
            """Complete groups: the large ones as they are, of the others the candidates."""
            if limit and len(x):
                _, inverse, count = np.unique(x[:, 0], return_inverse=True, return_counts=True)
                big = count[inverse] > limit
                if big.any():
                    yield spill(x[big])
                    x = x[~big]
            if len(x):
                yield from settle(x)

        for table in batches:
            names = table.schema.names
            x = np.zeros((table.num_rows, len(_COLUMNS)), np.int64)
            for k, name in enumerate(_COLUMNS):
                if name in names:
                    x[:, k] = table.column(name).to_numpy()
            if not len(x):
                continue
            if large is not None:
                same = np.all(x[:, :2] == large, axis=1)
                if same.any():
                    yield spill(x[same])
                x = x[~same]
                if not len(x):
                    continue
                large = None
            held.append(x)
            rows += len(x)
            if rows < 1 << 17:
                continue
            x = np.concatenate(held)
            tail = np.all(x[:, :2] == x[-1, :2], axis=1)
            done, rest = x[~tail], x[tail]
            yield from finish(done)
            if limit and len(rest) > limit:
                yield spill(rest)
                large, held, rows = rest[-1, :2].copy(), [], 0
            else:
                held, rows = [rest], len(rest)
        if rows:
            yield from finish(np.concatenate(held))

    return run


_MET = "doc long, uid long, to_doc long, to_uid long, open boolean, word long, large boolean"
_WORDS = "word long, size long, doc long, uid long, b1 long, b2 long"
#: Words that are looked for and go to the tasks as a list, when they were counted to be no more.
ASKED = 100_000


def _candidates(words: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """Candidate pairs of lines that meet by a word; with ``side``, 3 is a line looked for and 4 one of the others."""
    met = written(words.repartition("word").sortWithinPartitions("word").mapInArrow(_meet(percent, nearest, GROUP), _MET))
    pairs = met.where("not large").drop("word", "large")
    large = met.where("large").select("word", "doc", "uid")
    if large.isEmpty():
        return pairs
    sizes = large.groupBy("word").agg(F.ceil(F.count(F.lit(1)) * 2 / GROUP).cast("int").alias("blocks"))
    if "side" not in words.columns:
        words = words.withColumn("side", F.lit(0))
    rows = words.join(sizes, "word").withColumn("mine", F.pmod(F.xxhash64("doc", "uid"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    rows = rows.select("*", other).withColumn("block", F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other"))
    side = F.when(F.col("side") > 0, F.col("side")).when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    rows = rows.withColumn("side", side).select(*_COLUMNS)
    more = rows.repartition("word", "block").sortWithinPartitions("word", "block").mapInArrow(_meet(percent, nearest, 0), _MET)
    return pairs.unionByName(written(more).drop("word", "large"))


def _sets_of(order):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place, _ = order.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for a, b in chunks(texts, 1 << 21):
                word, bounds, first = _line_sets([t or "" for t in texts[a:b]], place)
                doc, uid, sets = [], [], []
                for k, (d, uids) in enumerate(zip(pdf["doc"].iloc[a:b], pdf["uids"].iloc[a:b])):
                    for u in uids:
                        line = first[k] + int(u)
                        doc.append(d)
                        uid.append(int(u))
                        sets.append(word[bounds[line] : bounds[line + 1]].view(np.int64))
                yield pd.DataFrame({"doc": doc, "uid": uid, "words": sets})

    return run


def _small(table: DataFrame, lists: str) -> bool:
    """Whether a written table of ids with lists of line numbers may be broadcast: its rows and its lists' entries are counted."""
    size = table.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size(lists)), F.lit(0)).alias("entries")).first()
    return size["rows"] <= BROADCAST_ROWS and size["entries"] <= BROADCAST_ENTRIES


def _verified(docs: DataFrame, pairs: DataFrame, order, percent: int) -> DataFrame:
    """Those of the pairs that match: doc, uid, to_doc, to_uid."""
    ends = pairs.select("doc", "uid").unionByName(pairs.select(F.col("to_doc").alias("doc"), F.col("to_uid").alias("uid"))).distinct()
    wanted = written(ends.groupBy("doc").agg(F.collect_list("uid").alias("uids")))
    texts = docs.join(F.broadcast(wanted) if _small(wanted, "uids") else wanted, "doc").select("doc", "uids", "text")
    sets = written(texts.mapInPandas(_sets_of(order), "doc long, uid long, words array<bigint>"))
    to = sets.select(F.col("doc").alias("to_doc"), F.col("uid").alias("to_uid"), F.col("words").alias("to_words"))
    both = F.size(F.array_intersect("words", "to_words"))
    joined = pairs.join(sets, ["doc", "uid"]).join(to, ["to_doc", "to_uid"])
    return joined.where(100 * both >= percent * (F.size("words") + F.size("to_words") - both)).select("doc", "uid", "to_doc", "to_uid")


def line_matches(docs: DataFrame, percent: int) -> DataFrame:
    """(doc, uid) of each line that matches an earlier one; ``docs``: doc (each once), text.  ``uid`` is the line number."""
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(word_order(docs))
    lines = written(
        docs.mapInPandas(_describe(order, percent), "doc long, uid long, n long, skip long, d1 long, d2 long, prefix binary, b1 long, b2 long")
    )
    kept = ["doc", "uid", "skip", "prefix", "b1", "b2"]
    firsts = written(lines.groupBy("n", "d1", "d2").agg(F.min(F.struct(*kept)).alias("f")).select("n", "d1", "d2", "f.*"))
    copies = lines.select("doc", "uid", "n", "d1", "d2").join(firsts.select("doc", "uid"), ["doc", "uid"], "left_anti").select("doc", "uid")
    words = firsts.where("octet_length(prefix) > 0").select("doc", "uid", "n", "skip", "prefix", "b1", "b2").mapInArrow(_by_word(), _WORDS)
    near = _candidates(words, percent, NEAREST)
    found = written(_verified(docs, near.select("doc", "uid", "to_doc", "to_uid").distinct(), order, percent).select("doc", "uid").distinct())
    # lines with further candidates and no match yet go through all of them
    rest = written(near.where("open").select("doc", "uid").distinct().join(found, ["doc", "uid"], "left_anti"))
    if not rest.isEmpty():
        sought = rest.withColumn("sought", F.lit(True))
        marked = firsts.where("octet_length(prefix) > 0").join(sought, ["doc", "uid"], "left").select("doc", "uid", "n", "skip", "prefix", "b1", "b2", F.coalesce("sought", F.lit(False)).alias("probe"))
        schema = _WORDS + ", probe boolean"
        asked = written(marked.where("probe").mapInArrow(_by_word(), schema).select("word").distinct())
        if asked.count() <= ASKED:
            rows = marked.mapInArrow(_by_word(np.array([r["word"] for r in asked.collect()], np.int64)), schema)
        else:
            rows = marked.mapInArrow(_by_word(), schema).join(asked, "word", "left_semi")
        rows = rows.withColumn("side", F.when(F.col("probe"), 3).otherwise(4)).drop("probe")
        tried = near.select("doc", "uid", "to_doc", "to_uid")
        more = _candidates(rows, percent, None).select("doc", "uid", "to_doc", "to_uid").distinct().join(tried, ["doc", "uid", "to_doc", "to_uid"], "left_anti")
        found = found.unionByName(_verified(docs, written(more), order, percent).select("doc", "uid").distinct())
    return copies.unionByName(found)


def dedup_lines(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, lines_col: str = "n_lines", removed_col: str = "removed"
) -> DataFrame:
    """The documents without lines that match an earlier line; ``lines_col``: lines before, ``removed_col``: numbers of the removed lines (from 0)."""
    doc, th, gone, lines_col, removed_col = fresh(documents.columns, "doc", "th", "gone", lines_col, removed_col)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    rows = documents.withColumn(doc, key)
    if rows.groupBy(doc).count().where("count > 1").isEmpty():
        docs = rows.select(F.col(doc).alias("doc"), F.col(text_col).alias("text"))
    else:
        rows = rows.withColumn(th, F.xxhash64(F.col(text_col)))
        numbers = written(numbered(rows.select(F.col(doc).alias("id"), F.col(th).alias("h")).distinct(), ["id", "h"]))
        number, i, h = fresh(rows.columns, "number", "i", "h")
        rows = rows.join(numbers.toDF(i, h, number), (F.col(doc) == F.col(i)) & (F.col(th) == F.col(h)))
        rows = written(rows.withColumn(doc, F.col(number)).drop(i, h, number, th))
        docs = rows.groupBy(F.col(doc).alias("doc")).agg(F.first(text_col).alias("text"))
    matches = line_matches(docs, percent)
    by_doc = matches.groupBy(F.col("doc").alias(doc))
    removed = written(by_doc.agg(F.array_sort(F.collect_list(F.col("uid").cast("int"))).alias(gone)))
    rows = rows.join(F.broadcast(removed) if _small(removed, gone) else removed, doc, "left")
    parts = F.split(F.col(text_col), "\n", -1)
    rest = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains(F.col(gone), i)), "\n")
    columns = [F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest).alias(c) if c == text_col else F.col(c) for c in documents.columns]
    none = F.array().cast("array<int>")
    return rows.select(*columns, F.when(F.col(text_col).isNull(), 1).otherwise(F.size(parts)).alias(lines_col), F.coalesce(F.col(gone), none).alias(removed_col))
