"""Mixing sources to target weights over output shards, by a multivariate-hypergeometric splitting tree.

DataFrame functions only. Each source is a stream: its documents in a random but repeatable order, word by word.
A source gives whole passes over its stream and then the beginning of one more, so it meets its target to
the word and at most one of its documents is cut. Streams are cut into blocks of documents. A tree splits the
drawn blocks of all sources among the shards: each node halves its number of blocks, and how many of them
come from which source is a multivariate hypergeometric draw, so quotas are kept exactly at every node.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filmloom.plans.storage import write_through

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # words of the mix for each word of the sources
MOST = 2  # passes over a source
SHARD_WORDS = 50_000_000
BLOCKS_PER_SHARD = 64
BLANK_RUN = r"[\x20\x09-\x0D]+"
SEED = 11
BUCKET_ROWS = 4096


def word_count(text: Column) -> Column:
    """Number of runs of characters that are not blank."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(inner, BLANK_RUN))).cast("bigint")


def source_targets(sized: DataFrame) -> DataFrame:
    """``source``, ``src`` (its rank), ``source_size``, ``n_docs`` and ``target`` per source; ``sized`` has ``source`` and ``size``.

    Water filling: a source gets ``level * weight`` words but no more than its cap, and the level is the
    largest of those that exhaust the budget with the k tightest sources at their caps. One row per source,
    so the windows without partition see no documents.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    ranked = per.withColumn("src", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.col("src") - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    every = Window.partitionBy()
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(after)
    filled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    return filled.select("source", "src", "source_size", "n_docs", F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``then``."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _hypergeometric(items: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """Number of marked items among ``drawn`` of ``items``, by inversion of ``u``.

    Sums the probabilities within eight standard deviations of the mean, which is the whole support when
    numbers are small; the work grows with the square root of the numbers, not with the numbers.
    """
    n, k, d = F.greatest(items, F.lit(1).cast("bigint")).cast("double"), marked.cast("double"), drawn.cast("double")
    mean = d * k / n
    spread = 8 * F.sqrt(F.greatest(F.lit(0.0), mean * (1 - k / n) * (n - d) / F.greatest(n - 1, F.lit(1.0)))) + 1
    low = F.greatest(F.lit(0).cast("bigint"), drawn - (items - marked), F.floor(mean - spread).cast("bigint"))
    high = F.least(drawn, marked, F.ceil(mean + spread).cast("bigint"))

    def ratio(x: Column) -> Column:
        x = x.cast("double")
        return (k - x) * (d - x) / ((x + 1) * (n - k - d + x + 1))

    zero = F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("sum"), F.lit(-1).cast("bigint").alias("x"))

    def step(goal: Column):
        def inner(a: Column, x: Column) -> Column:
            total = a["sum"] + a["w"]
            return F.struct((a["w"] * ratio(x)).alias("w"), total.alias("sum"), F.when((a["x"] < 0) & (total > goal), x).otherwise(a["x"]).alias("x"))

        return inner

    def draw(support: Column) -> Column:
        return _let(
            F.aggregate(support, zero, step(F.lit(float("inf"))))["sum"] * u,
            lambda goal: _let(F.aggregate(support, zero, step(goal))["x"], lambda x: F.when(x < 0, F.element_at(support, -1)).otherwise(x)),
        )

    return F.when((items <= 0) | (low >= high), F.greatest(high, F.lit(0).cast("bigint"))).otherwise(_let(F.sequence(low, F.greatest(low, high)), draw))


def _left_quotas(quotas: Column, node: Column) -> Column:
    """Quotas of the left child: half of the node's blocks, drawn source by source."""
    total = F.aggregate(quotas, F.lit(0).cast("bigint"), lambda a, q: a + q)
    start = F.struct(total.alias("items"), F.floor(total / 2).cast("bigint").alias("drawn"), F.array().cast("array<bigint>").alias("out"))

    def take(state: Column, entry: Column) -> Column:
        u = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), node, entry["i"]), 11) / F.lit(float(1 << 53))
        return _let(
            _hypergeometric(state["items"], entry["q"], state["drawn"], u),
            lambda x: F.struct((state["items"] - entry["q"]).alias("items"), (state["drawn"] - x).alias("drawn"), F.concat(state["out"], F.array(x)).alias("out")),
        )

    return F.aggregate(F.transform(quotas, lambda q, i: F.struct(q.alias("q"), i.alias("i"))), start, take)["out"]


def shard_quotas(quotas: DataFrame, levels: int) -> DataFrame:
    """``shard``, ``src``, ``quota`` for ``2 ** levels`` shards; ``quotas`` has one row per source with ``src`` and ``blocks``."""
    tree = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("src", "blocks"))).alias("all")).select(
        F.lit(1).cast("bigint").alias("node"), F.transform("all", lambda s: s["src"]).alias("sources"), F.transform("all", lambda s: s["blocks"]).alias("quotas")
    )
    for _ in range(levels):
        left = tree.withColumn("left", _left_quotas(F.col("quotas"), F.col("node")))
        sides = F.array(
            F.struct((2 * F.col("node")).alias("node"), F.col("left").alias("quotas")),
            F.struct((2 * F.col("node") + 1).alias("node"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas")),
        )
        tree = left.select("sources", F.explode(sides).alias("child")).select("child.node", "sources", "child.quotas")
    flat = tree.select((F.col("node") - (1 << levels)).alias("shard"), F.explode(F.arrays_zip("sources", "quotas")).alias("q"))
    return flat.select("shard", F.col("q.sources").alias("src"), F.col("q.quotas").alias("quota"))


def _streamed(sized: DataFrame) -> DataFrame:
    """Add ``start``, each document's first word in its source's stream; ``sized`` has ``src``, ``n_docs``, ``order``, ``size``.

    Prefix sums on two levels of buckets of the order, so no task holds a source.
    """
    bits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n_docs") / BUCKET_ROWS))).cast("int")
    spread = F.shiftrightunsigned("order", 1)  # 63 bits, not negative
    cut = sized.withColumn("fine", F.floor(spread / F.pow(F.lit(2.0), 63 - bits)).cast("bigint")).withColumn("coarse", F.floor(F.col("fine") / F.pow(F.lit(2.0), F.floor(bits / 2))).cast("bigint"))
    sums = cut.groupBy("src", "coarse", "fine").agg(F.sum("size").alias("n"))
    upto = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    fine = sums.withColumn("a", F.coalesce(F.sum("n").over(upto("src", "coarse", "fine")), F.lit(0)))
    coarse = sums.groupBy("src", "coarse").agg(F.sum("n").alias("n")).withColumn("b", F.coalesce(F.sum("n").over(upto("src", "coarse")), F.lit(0)))
    offsets = fine.join(coarse.select("src", "coarse", "b"), ["src", "coarse"]).select("src", "fine", (F.col("a") + F.col("b")).alias("offset"))
    inside = Window.partitionBy("src", "fine").orderBy("order", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(offsets, ["src", "fine"]).withColumn(
        "start", F.col("inner") + F.col("offset")
    ).drop("inner", "offset", "fine", "coarse")


def draws(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``row`` (a hash of its text), ``source``, ``size``, ``source_size``, ``target`` and ``draws``.

    ``draws`` lists each time the mix takes the document: ``pass``, ``words`` (fewer than ``size`` only for the one
    document per source that is cut), ``shard`` and ``position``, the order inside the shard.

    Sources are ordered by code point with null last and weigh 5, 2, 1, repeating. The mix has 150 % of all
    words; a source stops at twice its size and the rest is shared anew by weight. A null or empty text has
    size 0 and is never drawn; a null doc_id is an id like any other. Repeated rows are drawn one by one. Reruns give
    the same draws. An empty table gives an empty table. Other columns are not read.
    """
    sized = write_through(
        docs.select(F.col("doc_id").cast("bigint"), F.xxhash64("text").alias("row"), F.col("source").cast("string"), word_count(F.col("text").cast("string")).alias("size")), "sizes"
    )
    targets = write_through(source_targets(sized), "targets")
    facts = targets.agg(F.count(F.lit(1)), F.sum("source_size")).first()
    words = SHARE * (facts[1] or 0)
    levels = max(0, int(words / SHARD_WORDS)).bit_length()
    block = max(256, int(words / (BLOCKS_PER_SHARD << levels)))
    if facts[0] <= 100_000:  # a few bytes per source, counted
        targets = F.broadcast(targets)
    order = F.xxhash64(F.lit(SEED), "doc_id", "row")
    # Read three times below: written, so that its windows stand in one plan only.
    placed = write_through(_streamed(
        sized.join(targets.withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source").withColumn("order", order)
    ), "placed")
    # Words that pass p still takes: all of the stream, its beginning, or nothing.
    goal = F.round("target").cast("bigint")
    passes = F.transform(
        F.sequence(F.lit(0), F.lit(MOST - 1)),
        lambda p: F.struct(p.alias("pass"), F.least(F.col("size"), F.greatest(F.lit(0), goal - p * F.col("source_size") - F.col("start"))).cast("bigint").alias("words")),
    )
    blocks_in = F.ceil(F.col("source_size") / block).cast("bigint")
    drawn_blocks = F.floor(goal / F.col("source_size")).cast("bigint") * blocks_in + F.ceil(F.pmod(goal, F.col("source_size")) / block).cast("bigint")
    quotas = targets.filter("source_size > 0").select("src", drawn_blocks.alias("blocks"))
    # The k-th block of a source in permuted order goes to the shard whose range of quotas holds k.
    upto = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = shard_quotas(quotas, levels).withColumn("to", F.sum("quota").over(upto)).filter("quota > 0")
    dealt = ranges.select("src", "shard", F.explode(F.sequence(F.col("to") - F.col("quota"), F.col("to") - 1)).alias("k"))
    prime = F.lit(2_147_483_647)
    taken = placed.select("*", F.explode(F.filter(passes, lambda p: p["words"] > 0)).alias("p")).withColumn("blocks", drawn_blocks).withColumn(
        "draw", F.col("p.pass") * blocks_in + F.floor(F.col("start") / block).cast("bigint")
    ).withColumn("k", F.pmod(F.pmod(prime, F.col("blocks")) * F.col("draw") + F.pmod(F.xxhash64(F.lit(SEED), "src"), F.col("blocks")), F.col("blocks")))
    position = F.xxhash64(F.lit(SEED), "doc_id", "row", "p.pass", "start")
    one = F.struct(F.col("p.pass").alias("pass"), F.col("p.words").alias("words"), "shard", position.alias("position"))
    per_row = taken.join(dealt, ["src", "k"]).groupBy("src", "start").agg(F.array_sort(F.collect_list(one)).alias("draws"))
    # Rows with words have a start of their own in the stream, so it names them even among equal rows.
    facts = ["doc_id", "row", "source", "size", "source_size", "target"]
    none = F.array().cast("array<struct<pass:int,words:bigint,shard:bigint,position:bigint>>")
    with_words = placed.filter("size > 0").join(per_row, ["src", "start"], "left").select(*facts, F.coalesce("draws", none).alias("draws"))
    return with_words.unionByName(placed.filter("size = 0").select(*facts, none.alias("draws")))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: a row of ``docs`` for each draw, with ``shard``, ``pass`` and ``position`` added.

    The text of the one cut document per source ends after its drawn words. The order inside a
    shard is that of position, which is random; rows come sorted by it in pieces of a shard. If ``docs`` has columns of these three names, theirs give way to the new ones.
    """
    names = [c for c in docs.columns if c not in ("shard", "pass", "position")]
    row, source = F.xxhash64("text"), F.col("source").cast("string")
    same = Window.partitionBy("__id", "__row", "__source").orderBy(F.lit(1))
    rows = docs.select(*[f"`{c}`" for c in names], F.col("doc_id").cast("bigint").alias("__id"), row.alias("__row"), source.alias("__source"))
    # Equal rows share one list of draws; the first of them stands for all.
    rows = rows.withColumn("__copy", F.row_number().over(same)).filter("__copy = 1")
    every = write_through(draws(docs).select("doc_id", "row", "source", "size", F.explode("draws").alias("__draw")), "draws")
    joined = rows.join(every.select(F.col("doc_id").alias("__a"), F.col("row").alias("__b"), F.col("source").alias("__c"), F.col("size").alias("__size"), "__draw"),
                       F.col("__id").eqNullSafe(F.col("__a")) & F.col("__row").eqNullSafe(F.col("__b")) & F.col("__source").eqNullSafe(F.col("__c")))
    runs = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("__draw.words") < F.col("__size"), F.array_join(F.slice(runs, 1, F.col("__draw.words").cast("int")), "")).otherwise(F.col("text"))
    placed = joined.select(
        *[cut.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], F.col("__draw.shard").alias("shard"), F.col("__draw.pass").alias("pass"), F.col("__draw.position").alias("position")
    )
    # A shard is written in eight pieces, each a range of positions, so that no task holds a whole one.
    return placed.repartition("shard", F.shiftright("position", 61)).sortWithinPartitions("shard", "position")
