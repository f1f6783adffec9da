"""Documents that hold benchmark items: SimHash of item-sized windows, with DataFrame functions only.

A window of a document is as many words as an item has. Where a five-word shingle of an item occurs in a
document, two windows are laid: the one in which the shingle has the same place as in the item, and the one that
ends with it. The latter are enough to find the most similar window of all, in whatever order the item's parts
come: moved to the left, a window that neither starts the document nor ends with a shingle of the item loses
none. Only windows that hold as many of the item's shingles as the threshold asks for are kept. Of equally
similar places one with a shingle in its place goes first, then the earliest. Windows of equal content are folded. Windows and items of one
length get 64-bit fingerprints (SimHash over shingles, weighted by counts), cut into BLOCKS blocks. Of two
fingerprints at most RADIUS bits apart one block differs by at most a BLOCKS-th of them, rounded down, so the items,
the bounded side, are listed under every block value that near to their own, and an equality join on blocks finds
all pairs within the radius (and one unrelated pair in seven, before distances are compared). Every pair within it is
then compared exactly, by the weighted Jaccard similarity of the shingles.

Defined cases: null and empty texts hold nothing; items of fewer than five words have no shingle and are never
found; documents shorter than an item are compared as a whole; repeated documents and items give rows of
their own ids; a row without an id is reported with a null id; other columns are ignored; with an empty table
on either side nothing is found.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trafficlens.llm.shingles import SIMILAR, WORDS, native_shingles, word_hashes
from trafficlens.session import written

BITS = 64
# At the similarity of 0.8 fingerprints differ by 10 bits on average, with a standard deviation of 3.
RADIUS = 19
# Blocks of a fingerprint. Four of 16 bits with values up to 4 bits away: 2,517 of 65,536 values per block and item.
BLOCKS = 4
# Shingles of items up to which they are broadcast (32 bytes each); beyond, the join is dealt by shingle.
BROADCAST_ROWS = 1_000_000


def _fingerprints(rows: DataFrame, key: list[str]) -> DataFrame:
    """SimHash per `key` from rows with `h`, one per shingle occurrence.

    Two bits are counted in each of 32 sums: bit b in the low and bit b + 32 in the high half.
    """
    halves = F.lit(0x0000000100000001).cast("long")
    sums = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(halves)).alias(f"_s{b}") for b in range(BITS // 2)]
    counted = rows.groupBy(*key).agg(F.count("*").alias("shingles"), *sums)
    total = F.lit(0).cast("long")
    for b in range(BITS // 2):
        low, high = F.col(f"_s{b}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"_s{b}", 32)
        for count, bit in ((low, b), (high, b + 32)):
            set_bit = F.lit(1 << bit if bit < 63 else -(2**63)).cast("long")
            total = total.bitwiseOR(F.when(2 * count > F.col("shingles"), set_bit).otherwise(F.lit(0).cast("long")))
    return counted.select(*key, "shingles", total.alias("print"))


def _blocks() -> Column:
    """Value of every block of a fingerprint, with its number."""
    width = BITS // BLOCKS
    value = lambda at: F.shiftrightunsigned("print", at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
    return F.posexplode(F.array(*[value(i * width) for i in range(BLOCKS)])).alias("block", "value")


def _near(radius: int) -> Column:
    """All differences of a block in which two fingerprints within the radius may meet: constant, one per row."""
    differences = [str(m) for m in range(1 << BITS // BLOCKS) if m.bit_count() <= radius // BLOCKS]
    return F.explode(F.split(F.lit(",".join(differences)), ",").cast("array<bigint>")).alias("_off")


def _met(ours: DataFrame, theirs: DataFrame, radius: int) -> DataFrame:
    """Pairs of a window content (`ours`) and an item (`theirs`) that agree in a block, with `apart`, their distance;
    a pair may come once per block."""
    lengths = ours.select("n_words").distinct()
    near = theirs.join(lengths, "n_words", "left_semi").select("item_id", "n_words", "print", "shingles", _blocks())
    near = near.select("*", _near(radius)).withColumn("value", F.col("value").bitwiseXOR(F.col("_off"))).drop("_off")
    # Ten thousand rows per item are dealt by block value; few items would be broadcast, which takes the driver's memory.
    near = near.hint("merge")
    own = ours.select("content", "n_words", F.col("print").alias("own"), F.col("shingles").alias("own_n"), _blocks())
    return own.join(near, ["n_words", "block", "value"]).select(
        "content", "n_words", "item_id", "own_n", F.col("shingles").alias("item_n"),
        F.bit_count(F.col("own").bitwiseXOR(F.col("print"))).alias("apart"),
    )


def item_shingles(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """`item_id, n_words, at, h` per shingle of an item."""
    read = items.select(F.col(item_col).alias("item_id"), word_hashes(F.col(text_col)).alias("_w"))
    read = read.select("item_id", F.size("_w").alias("n_words"), native_shingles(F.col("_w")).alias("_s"))
    return read.select("item_id", "n_words", F.posexplode("_s").alias("at", "h"))


def _laid(n_words: Column, own: Column, at: Column, count: Column) -> Column:
    """The two places of a window whose shingle number `own`, of `count`, is number `at` of an item."""
    width = n_words - (WORDS - 1)
    begin = lambda start: F.greatest(F.lit(0), F.least(start, count - width))
    return F.inline(
        F.array(
            F.struct(begin(own - at).alias("start"), F.lit(True).alias("aligned")),
            F.struct(begin(own - width + 1).alias("start"), F.lit(False).alias("aligned")),
        )
    )


def _places(docs: DataFrame, places: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """`doc_id, n_words, distinct, start, aligned, window` for each shared shingle, items broadcast."""
    read = docs.select(F.col(id_col).alias("doc_id"), native_shingles(word_hashes(F.col(text_col))).alias("_s"))
    # The outer form keeps Spark from testing the size first, for which it would compute the array again.
    hits = read.select("doc_id", "_s", F.posexplode_outer("_s").alias("_at", "h"))
    found = hits.join(F.broadcast(places), "h").join(F.broadcast(known), ["item_id", "n_words"])
    starts = _laid(F.col("n_words"), F.col("_at"), F.col("at"), F.size("_s"))
    return found.select("doc_id", "_s", "n_words", "distinct", starts).select("*", _window()).drop("_s")


def _window() -> Column:
    return F.slice("_s", F.col("start") + 1, F.col("n_words") - (WORDS - 1)).alias("window")


def _dealt_places(docs: DataFrame, places: DataFrame, known: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same, dealt by shingle: a shingle moves with its place and its text's digest only, and a text is fetched
    once for all windows laid in it."""
    digest = F.struct(F.xxhash64(text_col).alias("a"), F.xxhash64(F.lit(1), text_col).alias("b")).alias("_text")
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), digest, F.col(text_col).alias("_t"))
    shingled = native_shingles(word_hashes(F.col("_t"))).alias("_s")
    hits = texts.select("_text", shingled).select("_text", F.size("_s").alias("_n"), F.posexplode_outer("_s").alias("_at", "h"))
    found = hits.join(places, "h")
    starts = _laid(F.col("n_words"), F.col("_at"), F.col("at"), F.col("_n"))
    starts = found.select("_text", "item_id", "n_words", starts)
    starts = starts.groupBy("_text", "item_id", "n_words", "start").agg(F.max("aligned").alias("aligned"))
    starts = written(starts, "leak-starts")
    hit = texts.join(starts.select("_text").distinct(), "_text", "left_semi").select("doc_id", "_text", shingled)
    cut = hit.join(starts, "_text").select("doc_id", "item_id", "n_words", "start", "aligned", _window())
    return cut.join(known, ["item_id", "n_words"]).drop("item_id")


def _windows(laid: DataFrame, threshold: float) -> DataFrame:
    """`doc_id, start, n_words, aligned, content, window` for each place where an item may lie."""
    width = F.col("n_words") - (WORDS - 1)
    # Every shingle of the window may be shared as often as the item repeats it.
    shared = F.size(F.array_intersect("window", "distinct")) + width - F.size("distinct")
    least = threshold / (1 + threshold) * (F.size("window") + width) - 1e-6
    laid = laid.where(shared >= least)
    once = laid.groupBy("doc_id", "start", "n_words", F.xxhash64("window").alias("_a"), F.hash("window").alias("_b")).agg(
        F.first("window").alias("window"), F.max("aligned").alias("aligned")
    )
    return once.select("doc_id", "start", "n_words", "aligned", F.struct("_a", "_b").alias("content"), "window")


def contaminated(
    docs: DataFrame, items: DataFrame, *, threshold: float = SIMILAR, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """`doc_id, item_id, start_word, n_words, similarity`: the best place of each item a document holds."""
    listed = written(item_shingles(items, item_col, item_text_col), "leak-items")
    places = listed.select("h", "item_id", "n_words", "at").distinct()
    known = listed.groupBy("item_id", "n_words").agg(F.collect_set("h").alias("distinct"))
    laid = _places if listed.count() <= BROADCAST_ROWS else _dealt_places
    windows = written(_windows(laid(docs, places, known, id_col, text_col), threshold), "leak-windows")

    contents = windows.groupBy("content", "n_words").agg(F.first("window").alias("window"))
    laid = written(contents.select("content", "n_words", F.explode("window").alias("h")), "leak-shingles")
    ours = _fingerprints(laid, ["content", "n_words"])
    theirs = _fingerprints(listed, ["item_id", "n_words"])
    met = _met(ours, theirs, radius).where(F.col("apart") <= radius).drop("apart").distinct()
    own = laid.groupBy("content", "n_words", "h").agg(F.count("*").alias("own_c"))
    item = listed.groupBy("item_id", "n_words", "h").agg(F.count("*").alias("item_c"))
    shared = (
        met.join(own, ["content", "n_words"])
        .join(item, ["item_id", "n_words", "h"])
        .groupBy("content", "n_words", "item_id", "own_n", "item_n")
        .agg(F.sum(F.least("own_c", "item_c")).alias("both"))
    )
    alike = shared.withColumn("similarity", F.col("both") / (F.col("own_n") + F.col("item_n") - F.col("both")))
    alike = alike.where(F.col("similarity") >= threshold).select("content", "n_words", "item_id", "similarity")
    best = F.max(F.struct("similarity", "aligned", (-F.col("start")).alias("start"))).alias("best")
    per = windows.drop("window").join(alike, ["content", "n_words"]).groupBy("doc_id", "item_id", "n_words").agg(best)
    return per.select(
        "doc_id", "item_id", (-F.col("best")["start"]).cast("long").alias("start_word"), "n_words", F.col("best")["similarity"].alias("similarity")
    )
