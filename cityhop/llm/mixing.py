"""Mixing sources to target weights with exact block quotas per output shard.

Targets: each source gets its weight's share of ``share`` times all words, but no more than ``most`` times its own
words; what is cut off is shared again by weight until no source is above (water filling, in closed form: sources in
order of capacity per weight, the level is the highest that those after each source reach).

Draws: a source's documents lie end to end in the order of a keyed hash, and that stream is cut into blocks of equal
size in words; a document belongs to the block in which it starts.  A source whose target is above its size is passed
whole first; the rest of the target is taken from the head of its permuted stream, and the document in which the
target falls is cut there, so the words taken equal the (rounded) target.

Shards: all blocks of all passes are dealt to ``2**levels`` shards by a multivariate hypergeometric splitting tree.  A node
holds a count of blocks per source; its left child takes half of the node's blocks without replacement (an exact
hypergeometric draw by inversion per source, given the sources before it), the right child the rest.  Quotas are exact in every
node.  A source's blocks, permuted again, are cut into ranges by those quotas, and each shard shuffles its documents by hash.

Everything is DataFrame operations.  Positions in a permuted stream come from sums per hash bucket and running sums
inside a bucket, so a source with a third of all rows is spread over its buckets.  Reruns agree: all
draws hash the seed.

Null sources form a source of their own (the last); null texts have no words and empty documents are never
cut (they follow the document before them and take 0 words); rows with equal ids are rows of their own, in the order of their text's hash;
extra columns are kept by ``mixed_documents`` and ignored by ``mix``; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cityhop.llm.scratch import fresh, written
from cityhop.llm.words import WORD_PATTERN

WEIGHTS = (3, 1, 2)
#: Words of a block at most; small targets have blocks of a thousandth of them.
BLOCK_WORDS = 1024
#: Documents of a hash bucket, about.
BUCKET_ROWS = 4096


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float, most: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row a source."""
    # strings compare by their UTF-8 bytes, which is the order of code points
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.select("source", "source_size", F.element_at(cycle, F.pmod(place, F.lit(len(weights))).cast("int") + 1).alias("w"))
    rows = rows.withColumn("cap", most * F.col("source_size"))
    everything = Window.partitionBy()
    by_level = Window.orderBy(F.col("cap") / F.col("w"), "source")
    # with the sources before this one at their caps, the others would hold this level (words per weight)
    level = (share * F.sum("source_size").over(everything) - (F.sum("cap").over(by_level) - F.col("cap"))) / (
        F.sum("w").over(everything) - (F.sum("w").over(by_level) - F.col("w"))
    )
    # it rises while the sources before it are full below it, and falls afterwards
    rows = rows.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return rows.select("source", "source_size", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") + 0.5) / float(1 << 53)


def _hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Marked ones among ``drawn`` of ``total`` without replacement, by inversion over all values within
    8 deviations of the mean (beyond them lies less than doubles resolve)."""
    mean = drawn * marked / F.greatest(total, F.lit(1.0))
    sd = F.sqrt(mean * (total - marked) / F.greatest(total, F.lit(1.0)) * (total - drawn) / F.greatest(total - 1, F.lit(1.0)))
    low = F.greatest(F.lit(0.0), drawn - (total - marked), F.floor(mean - 8 * sd) - 1)
    high = F.least(marked, drawn, F.ceil(mean + 8 * sd) + 1)
    steps = F.when(high > low, F.sequence(low.cast("long"), high.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    given = F.struct(marked.alias("m"), drawn.alias("d"), (total - marked - drawn + 1).alias("r"))

    def step(g: Column, k: Column) -> Column:  # P(k + 1) / P(k); weights are relative to that of the lowest value
        return (g["m"] - k) * (g["d"] - k) / ((k + 1) * (g["r"] + k))

    mass = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), given.alias("g")),
        lambda a, k: F.struct((a["w"] * step(a["g"], k)).alias("w"), (a["sum"] + a["w"]).alias("sum"), a["g"].alias("g")),
        lambda a: a["sum"] + a["w"],
    )
    # the weights from each value on are taken off the goal until it is used up
    return F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("w"), (u * mass).alias("goal"), low.alias("at"), given.alias("g")),
        lambda a, k: F.struct(
            (a["w"] * step(a["g"], k)).alias("w"),
            (a["goal"] - a["w"]).alias("goal"),
            F.when(a["goal"] >= a["w"], k + 1.0).otherwise(a["at"]).alias("at"),
            a["g"].alias("g"),
        ),
        lambda a: a["at"],
    )


def split_quotas(blocks: DataFrame, levels: int, seed: int) -> DataFrame:
    """(place, blocks) per source to (shard, place, quota).  A node of the tree is a row with its sources'
    counts, so the table has a row per shard and an entry per source; no level shuffles."""
    node = blocks.agg(F.array_sort(F.collect_list(F.struct("place", F.col("blocks").cast("double").alias("n")))).alias("s")).select(F.lit(0).alias("shard"), "s")
    for level in range(levels):
        everything = F.aggregate("s", F.lit(0.0), lambda a, x: a + x["n"])
        # which half gets the odd block alternates by hash
        half = F.floor(everything / 2) + F.pmod(everything, F.lit(2.0)) * F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "shard"), F.lit(2))
        start = F.struct(
            half.cast("double").alias("left"), everything.alias("total"), F.array().cast("array<struct<place:int,n:double,l:double>>").alias("out")
        )

        def draw(a: Column, x: Column, level=level) -> Column:
            # ``left`` of the state is from before its last draw, so that each draw is evaluated once
            left = a["left"] - F.when(F.size(a["out"]) > 0, F.element_at(a["out"], -1)["l"]).otherwise(0.0)
            got = _hypergeometric(a["total"], x["n"], left, _uniform(F.lit(seed), F.lit(level), F.col("shard"), x["place"]))
            taken = F.struct(x["place"].alias("place"), x["n"].alias("n"), got.alias("l"))
            return F.struct(left.alias("left"), (a["total"] - x["n"]).alias("total"), F.concat(a["out"], F.array(taken)).alias("out"))

        def halves(a: Column) -> Column:
            return F.array(
                F.struct((2 * F.col("shard")).alias("shard"), F.transform(a["out"], lambda x: F.struct(x["place"].alias("place"), x["l"].alias("n"))).alias("s")),
                F.struct((2 * F.col("shard") + 1).alias("shard"), F.transform(a["out"], lambda x: F.struct(x["place"].alias("place"), (x["n"] - x["l"]).alias("n"))).alias("s")),
            )

        # the outer explode evaluates the draws once (the inner one also filters on them)
        node = node.select(F.explode_outer(F.aggregate("s", start, lambda a, x: draw(a, x), halves)).alias("x")).select("x.shard", "x.s")
    return node.select("shard", F.explode_outer("s").alias("x")).select("shard", "x.place", F.col("x.n").cast("long").alias("quota")).where("place is not null")


#: Rounds of the block permutation, and steps after which a block that is still outside has a chance under 10**-14.
ROUNDS, WALK = 3, 24


def permuted(block: Column, blocks: Column, seed: int, key: Column) -> Column:
    """The place of ``block`` (from 0) in a permutation of ``blocks`` blocks that ``seed`` and ``key`` choose.

    A Feistel network over a grid of about sqrt(blocks) rows: a row is moved by a hash of its column, then the column by
    a hash of its row.  Blocks that land on the grid's few cells too many go through it again.
    """
    high = F.ceil(F.sqrt(blocks.cast("double"))).cast("long")
    wide = F.ceil(blocks / high).cast("long")

    def once(x: Column) -> Column:
        state = F.struct(F.floor(x / wide).cast("long").alias("r"), F.pmod(x, wide).alias("c"))

        def turn(a: Column, i: Column) -> Column:
            row = F.pmod(a["r"] + F.pmod(F.xxhash64(F.lit(seed), key, i, a["c"]), high), high)
            return F.struct(row.alias("r"), F.pmod(a["c"] + F.pmod(F.xxhash64(F.lit(~seed), key, i, row), wide), wide).alias("c"))

        return F.aggregate(F.array(*[F.lit(i) for i in range(ROUNDS)]), state, turn, lambda a: a["r"] * wide + a["c"])

    def walk(x: Column, _: Column) -> Column:
        return F.when(x < blocks, x).otherwise(once(x))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(block.cast("long")), walk)


def mix(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    levels: int = 4,
    seed: int = 20_240_607,
) -> DataFrame:
    """One row per document: id, size, source_size, target, text_hash, copies (array of pass, words, shard).

    ``words`` of a copy are the first of its text; only one copy per source may be shorter than its text.
    """
    sized = written(
        documents.select(
            F.col(id_col).alias("id"),
            F.col(source_col).alias("source"),
            words_in(F.col(text_col)).alias("size"),
            F.xxhash64(F.col(text_col)).alias("th"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
        )
    )
    bits = max(6, (sized.count() // BUCKET_ROWS).bit_length())
    sized = sized.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    buckets = written(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")))
    by_source = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), share, most, weights)
    aim = F.round("target").cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(aim / F.col("source_size"))).otherwise(0).cast("long")
    by_source = (
        by_source.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")))
        .withColumn("block", F.greatest(F.lit(1), F.least(F.lit(BLOCK_WORDS), aim / 1000)).cast("long"))
        .withColumn("full", full)
        .withColumn("part", aim - F.col("full") * F.col("source_size"))
        .withColumn("whole", F.ceil(F.col("source_size") / F.col("block")))
        .withColumn("blocks", F.col("full") * F.col("whole") + F.ceil(F.col("part") / F.col("block")))
    )
    by_source = written(by_source)
    quotas = split_quotas(by_source.select("place", "blocks"), levels, seed)
    ends = quotas.groupBy("place").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("q"))
    upto = F.transform("q", lambda x, i: F.aggregate(F.slice("q", 1, i + 1), F.lit(0).cast("long"), lambda a, y: a + y["quota"]))
    by_source = written(by_source.join(ends, "place").withColumn("upto", upto).drop("q", "place"))

    along = Window.partitionBy("source", "bucket").orderBy("h", "id", "th").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bases = buckets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("words").over(before) - F.col("words")).alias("base"))
    placed = sized.withColumn("inside", F.sum("size").over(along) - F.col("size"))
    placed = placed.join(bases, placed["source"].eqNullSafe(bases["s"]) & (placed["bucket"] == bases["b"])).withColumn("start", F.col("base") + F.col("inside"))
    about = by_source.withColumnRenamed("source", "of")
    placed = placed.join(about, placed["source"].eqNullSafe(about["of"]))
    cut = F.greatest(F.lit(0).cast("long"), F.least("size", F.col("part") - F.col("start")))
    def copy(k: Column, words: Column) -> Column:
        block = k * F.col("whole") + F.floor(F.col("start") / F.col("block"))
        # documents without words at a stream's end start in the block after its last one
        position = permuted(F.least(block, F.col("blocks") - 1), F.col("blocks"), seed, F.col("source"))
        shard = F.size(F.filter("upto", lambda e: e <= position))
        return F.struct(k.cast("int").alias("pass"), words.alias("words"), shard.alias("shard"))

    wholes = F.when(F.col("full") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("full") - 1), lambda k: copy(k, F.col("size"))))
    rest = F.when(cut > 0, F.array(copy(F.col("full"), cut)))
    nothing = F.array().cast("array<struct<pass:int,words:bigint,shard:int>>")
    copies = F.concat(F.coalesce(wholes, nothing), F.coalesce(rest, nothing))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("th").alias("text_hash"), copies.alias("copies"))


def first_words(text: Column, n: Column) -> Column:
    """A text up to the end of its n-th word, as written."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n.cast("int")), "")


def mixed_documents(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: the documents' columns, a row per copy, cut where the mix cuts, and shard, order.

    Write it with ``repartition("shard")`` and ``sortWithinPartitions("order")`` to get shuffled shards.  Rows that are equal in
    id, text and source are drawn as one and repeated.
    """
    id_, th, drawn, shard, order = fresh(documents.columns, "mix_id", "mix_hash", "mix_copy", "shard", "order")
    plan = mix(documents, id_col, text_col, source_col, **options)
    copies = plan.select(F.col(id_col).alias(id_), F.col("text_hash").alias(th), "size", F.explode("copies").alias(drawn))
    copies = copies.groupBy(id_, th, "size", F.col(f"{drawn}.pass").alias("pass")).agg(F.first(drawn).alias(drawn))
    copies = copies.select(id_, th, F.struct("size", f"{drawn}.words", f"{drawn}.shard", f"{drawn}.pass").alias(drawn))
    rows = documents.withColumn(th + "_", F.xxhash64(F.col(text_col)))
    out = rows.join(copies, rows[id_col].eqNullSafe(copies[id_]) & (rows[th + "_"] == copies[th]))
    text = F.when(F.col(f"{drawn}.words") < F.col(f"{drawn}.size"), first_words(F.col(text_col), F.col(f"{drawn}.words"))).otherwise(F.col(text_col))
    columns = [text.alias(c) if c == text_col else F.col(c) for c in documents.columns]
    return out.select(*columns, F.col(f"{drawn}.shard").alias(shard), F.xxhash64(F.lit(options.get("seed", 1)), F.col(id_), F.col(f"{drawn}.pass")).alias(order))
