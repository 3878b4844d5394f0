"""Benchmark decontamination by template canonicalisation, in SQL functions only.

Numbers, names and units become typed placeholders; windows of the templates are hashed and joined
with the benchmark's; matches on one diagonal form an alignment, and the values in its slots must
map one to one between item and document. So a question asked again with other numbers is caught.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm._shared import SPACE, Saved, table

#: Template tokens in a window, how many of them must be words, and the aligned tokens that make a leak.
WINDOW, MIN_WORDS, MIN_TOKENS = 8, 5, 13
MIN_CONSISTENT = 0.8
#: Benchmark windows that are broadcast at most (16 bytes and a few each); a larger set is joined by shuffle.
MAX_BROADCAST = 1_000_000
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr day days week weeks month months year years hour hours minute minutes second seconds meter meters metre metres mile miles gram grams kilogram kilograms litre litres liter liters dollar dollars euro euros cent cents pound pounds percent degree degrees".split()
#: Numbers in words, and words that start a sentence without being a name.
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
STARTERS = (
    "a about above according add after all also although an and another any are as ask assume at based because before below between both but by calculate can choose compare complete compute consider could decide define describe determine "
    "did do does during each either every evaluate explain express fill find first for from give given has have he hence her here his how however i identify if in into is it its last let list many match may most multiply my name "
    "no not now of on only or other our out over please prove put read round select she should show simplify since so solve some state subtract such suppose tell than that the their them then there therefore these they this those though "
    "thus to translate true under until use using was we were what when where whether which while who whom whose why will with without would write yes you your"
).split()
_TRAIL, _LEAD = ".,;:!?\"')]}", "\"'([{"
NUM, NAME, UNIT = "\u0001num", "\u0001name", "\u0001unit"


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE, -1), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def template(words: Column) -> Column:
    """Each word's template token: a placeholder, or the word in lower case without outer punctuation.

    A number starts with a digit (or a sign or currency and a digit) or is one of NUMBERS; a unit is a
    word of UNITS right after a number; a name is an ASCII capital and a small letter on (so text all in
    capitals has no names), where a sentence starts only if it is none of STARTERS.
    """
    digit = lambda c: (c >= "0") & (c < ":")

    def canons(both: Column) -> Column:
        words, cores, lows, numbers = both["words"], both["cores"], both["lows"], both["numbers"]

        def canon(w: Column, i: Column) -> Column:
            low, second = F.get(lows, i), F.substring(w, 2, 1)
            starts = (i == 0) | F.substring(F.rtrim(F.get(words, i - 1), F.lit("\"')]}")), -1, 1).isin(".", "!", "?", ":")
            return (
                F.when(F.get(numbers, i), F.lit(NUM))
                .when((w >= "A") & (w < "[") & (second != "") & (second == F.lower(second)) & ~(starts & low.isin(STARTERS)), F.lit(NAME))
                .when(F.get(numbers, i - 1) & low.isin(UNITS), F.lit(UNIT))
                .when(w == "", F.get(words, i))
                .otherwise(low)
            )

        return F.transform(cores, canon)

    def number(w: Column, low: Column) -> Column:
        return digit(w) | (F.substring(w, 1, 1).isin("$", "+", "-", "€", "£") & digit(F.substring(w, 2, 1))) | low.isin(NUMBERS)

    bare = lambda w: F.ltrim(F.rtrim(w, F.lit(_TRAIL)), F.lit(_LEAD))
    # each array is named once: a lambda that held its expression would compute it again for every word
    cores = _let(words, lambda ws: F.struct(ws.alias("words"), F.transform(ws, bare).alias("cores")))
    lows = _let(cores, lambda x: F.struct(x["words"].alias("words"), x["cores"].alias("cores"), F.transform(x["cores"], lambda w: F.lower(w)).alias("lows")))
    both = _let(lows, lambda x: F.struct(x["words"].alias("words"), x["cores"].alias("cores"), x["lows"].alias("lows"), F.zip_with(x["cores"], x["lows"], number).alias("numbers")))
    return _let(both, canons)


def _window_hashes(tokens: Column, width: int) -> Column:
    """Hashes of all windows of ``width`` tokens, in order."""

    def rolled(h: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.when(F.size(h) < width, none).otherwise(F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(width)])))

    return _let(F.transform(tokens, lambda t: F.xxhash64(t)), rolled)


def _chains(at: Column, window: Column) -> Column:
    """(tokens, first) of all chains of runs in the sorted places of hits, longest first; more than half of a chain's windows are hits."""

    def of(b: Column) -> Column:
        """starts and ends: where in ``at`` each run of hits without a gap begins and ends."""
        at, starts, ends = b["at"], b["starts"], b["ends"]

        def chain(i: Column, j: Column) -> Column:
            s, e = F.get(starts, i), F.get(ends, j)
            return F.struct((F.get(at, e) - F.get(at, s) + window).alias("tokens"), F.get(at, s).alias("first"), (e - s + 1).alias("n"))

        last = F.size(starts) - 1
        all_ = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda i: F.transform(F.sequence(i, last), lambda j: chain(i, j))))
        return F.sort_array(F.filter(all_, lambda c: c["n"] * 2 > c["tokens"] - window), False)

    def runs(at: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(at) - 1)
        return F.struct(
            at.alias("at"),
            F.filter(places, lambda k: (k == 0) | (F.get(at, k - 1) != F.get(at, k) - 1)).alias("starts"),
            F.filter(places, lambda k: (k == F.size(at) - 1) | (F.get(at, k + 1) != F.get(at, k) + 1)).alias("ends"),
        )

    return _let(_let(at, runs), of)


def find_leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, min_words: int = MIN_WORDS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Benchmark items that documents hold, whole or in part, word for word or with other slot values.

    Returns (doc_id, item_id, start_word, item_start, n_tokens, coverage, n_slots, n_changed, consistent): the
    best alignment of each pair (a run of matching windows or a chain of runs, over half of whose windows match), kept if it has ``min_tokens`` tokens (or the item's all, if it has
    fewer) and its slots are consistent. An item shorter than the window is one window of its own
    length and must be found word for word. Null or empty texts on either side match nothing; a
    window with fewer than ``min_words`` plain words is no evidence, so an item without one matches nothing.
    Null or repeated doc_ids match by id and text, so repeated rows give one result; repeated items
    with one id count as one where equal; empty tables give no rows; other columns are ignored.
    """
    spark = documents.sparkSession
    saved = Saved(spark)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text")).where("text IS NOT NULL").distinct()
    items = items.select("item_id", words_of(F.col("text")).alias("words")).select("item_id", "words", template(F.col("words")).alias("tokens"))
    items = saved.save(items.select("item_id", F.xxhash64("words").alias("item_text"), "words", "tokens").where(F.size("tokens") >= min_words))
    long, shorts = F.size("tokens") >= window, range(min(window, max(1, min_words)), window)
    hashes = F.when(long, _window_hashes(F.col("tokens"), window))
    for width in shorts:
        hashes = hashes.when(F.size("tokens") == width, _window_hashes(F.col("tokens"), width))
    placed = items.select("item_id", "item_text", "tokens", F.size("tokens").alias("item_size"), F.posexplode(hashes).alias("ipos", "h"))
    plain = F.size(F.filter(F.slice("tokens", F.col("ipos") + 1, F.lit(window)), lambda t: ~t.startswith("\u0001")))
    placed = saved.save(placed.where(plain >= min_words).select("h", "item_id", "item_text", "item_size", "ipos"))
    widths = {r["w"]: r["n"] for r in placed.groupBy(F.least(F.lit(window), "item_size").alias("w")).agg(F.count("*").alias("n")).collect()}
    small = sum(widths.values()) <= MAX_BROADCAST
    key = F.xxhash64("doc_id", "text")
    tokens = docs.where("text IS NOT NULL").select("doc_id", key.alias("doc_key"), template(words_of(F.col("text"))).alias("tokens"))
    # short items are rare: their lengths are looked for only where the benchmark has them
    windows = reduce(DataFrame.union, [tokens.select("doc_id", "doc_key", F.posexplode(_window_hashes(F.col("tokens"), width)).alias("dpos", "h")) for width in sorted({window, *widths})])
    hits = windows.join(F.broadcast(placed) if small else placed, "h")
    lines = hits.groupBy("doc_id", "doc_key", "item_id", "item_text", "item_size", (F.col("dpos") - F.col("ipos")).alias("shift")).agg(F.sort_array(F.collect_set("ipos")).alias("at"))
    lines = lines.select("*", _chains(F.col("at"), F.least(F.lit(window), F.col("item_size"))).alias("chains")).drop("at")
    lines = lines.withColumn("chains", F.filter("chains", lambda c: c["tokens"] >= F.least(F.lit(min_tokens), F.col("item_size"))))
    lines = saved.save(lines.where(F.size("chains") > 0))
    wanted = lines.select("doc_key").distinct()
    texts = docs.where("text IS NOT NULL").withColumn("doc_key", key).join(wanted, "doc_key", "left_semi")
    texts = texts.groupBy("doc_key").agg(F.min("text").alias("text")).select("doc_key", words_of(F.col("text")).alias("dwords"))
    texts = texts.select("doc_key", "dwords", template(F.col("dwords")).alias("dtokens"))
    both = lines.join(texts, "doc_key").join(items.select("item_id", "item_text", "words", "tokens"), ["item_id", "item_text"])
    bare = lambda w: F.lower(F.rtrim(w, F.lit(_TRAIL)))

    def scored(c: Column) -> Column:
        """The chain's score, or null if its slots are not consistent."""
        slot = lambda p: F.get("tokens", p).startswith("\u0001") & F.get("dtokens", p + F.col("shift")).eqNullSafe(F.get("tokens", p))
        spots = F.filter(F.sequence(c["first"], c["first"] + c["tokens"] - 1), slot)
        pairs = F.array_distinct(F.transform(spots, lambda p: F.struct(bare(F.get("words", p)).alias("a"), bare(F.get("dwords", p + F.col("shift"))).alias("b"))))

        def judged(pairs: Column) -> Column:
            n = F.size(pairs)
            distinct = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda x: x[side])))
            agree = F.when(n == 0, F.lit(1.0)).otherwise(F.least(distinct("a"), distinct("b")) / n)
            changed = F.size(F.filter(pairs, lambda x: x["a"] != x["b"]))
            return F.struct(c["tokens"].cast("int").alias("n_tokens"), agree.alias("consistent"), (-(c["first"] + F.col("shift"))).cast("int").alias("s"), (-c["first"]).cast("int").alias("i"), (c["tokens"] / F.col("item_size")).alias("coverage"), n.alias("n_slots"), changed.alias("n_changed"))

        return _let(_let(pairs, judged), lambda m: F.when((m["consistent"] >= MIN_CONSISTENT) & ((F.col("item_size") >= window) | (m["n_changed"] == 0)), m))

    # longest first: once one is consistent, only equally long ones are looked at
    none = F.lit(None).cast("struct<n_tokens:int,consistent:double,s:int,i:int,coverage:double,n_slots:int,n_changed:int>")
    m = F.aggregate("chains", none, lambda acc, c: F.when(acc.isNotNull() & (acc["n_tokens"] > c["tokens"]), acc).otherwise(_let(scored(c), lambda new: F.when(acc.isNull() | (new > acc), new).otherwise(acc))))
    best = both.select("doc_id", "item_id", m.alias("m")).where("m IS NOT NULL").groupBy("doc_id", "item_id").agg(F.max("m").alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.s")).alias("start_word"), (-F.col("m.i")).alias("item_start"), "m.n_tokens", "m.coverage", "m.n_slots", "m.n_changed", "m.consistent")


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
