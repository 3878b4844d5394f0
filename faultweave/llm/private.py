"""Personal data by bootstrapped contextual extraction, in SQL functions only.

Strict regular expressions give seed entities. The words around them become lexical patterns; a
pattern-instance graph is scored in rounds (a pattern is as good as the share of its instances that
are trusted, an instance as good as its patterns together), and what good patterns hold besides the
seeds, if it has the shape of that kind, is added.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultweave.llm._shared import Saved, table

KINDS = ["email", "ip", "card", "phone"]
#: The contract's expressions with possessive repeats and starts only where a run starts or the last match ended: the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier that the seeds' expressions don't take: a run of such characters with a digit or an @.
CANDIDATE = r"(?<![A-Za-z0-9@._%+-])(?=[A-Za-z._%+-]*+[0-9@])[A-Za-z0-9@._%+-]{6,}+"
#: And groups of digits, bare or in brackets, that single blanks, dots or hyphens join: one span. It starts only where no such group goes on.
GROUPS = r"(?<![A-Za-z0-9@._%+-])(?<![0-9)][\x20.-])(?:\([0-9]++\)|[0-9]++)(?:[\x20.-]?(?:\([0-9]++\)|[0-9]++))++(?![A-Za-z@_%+]|[.-][A-Za-z0-9@_%+-])"
CONTEXT_CHARS, BLOCK = 64, 64
#: Added spans that are broadcast to the rows at most; with more, rows meet them by shuffle.
MAX_ADDED = 200_000
ROUNDS, MIN_SUPPORT, MIN_CONFIDENCE = 3, 3, 0.8
_SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def matches(text: Column, pattern: str) -> Column:
    """All matches with their places in code points and the text within CONTEXT_CHARS of them, from what split() leaves between them.

    Places are running sums, taken block by block: a fold over all matches would copy what it has so far for each of them.
    """
    ints = "array<int>"
    sum_ = lambda sizes: F.aggregate(sizes, F.lit(0), lambda a, x: a + x["gap"] + x["n"])

    def placed(x: Column) -> Column:
        sizes, blocks = x["sizes"], F.sequence(F.lit(0), F.floor((F.size(x["sizes"]) - 1) / BLOCK).cast("int"))
        block = lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK))
        heads = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + sum_(block(b)))))

        def inner(heads: Column) -> Column:
            def step(acc: Column, x: Column) -> Column:
                return F.struct((acc["at"] + x["gap"] + x["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x["gap"])).alias("out"))

            return F.flatten(F.transform(blocks, lambda b: F.aggregate(block(b), F.struct(F.get(heads, b).alias("at"), F.array().cast(ints).alias("out")), step, lambda acc: acc["out"])))

        def one(start: Column, i: Column) -> Column:
            before, after = F.substring(F.get(x["pieces"], i), -CONTEXT_CHARS, CONTEXT_CHARS), F.substring(F.get(x["pieces"], i + 1), 1, CONTEXT_CHARS)
            return F.struct(start.alias("start"), (start + F.get(sizes, i)["n"]).alias("end"), F.get(x["hits"], i).alias("value"), before.alias("before"), after.alias("after"))

        return F.transform(_let(heads, inner), one)

    def measured(x: Column) -> Column:
        sizes = F.zip_with(F.slice(x["pieces"], 1, F.size(x["hits"])), x["hits"], lambda p, h: F.struct(F.char_length(p).alias("gap"), F.char_length(h).alias("n")))
        return _let(F.struct(x["hits"].alias("hits"), x["pieces"].alias("pieces"), sizes.alias("sizes")), placed)

    def found(hits: Column) -> Column:
        return F.when(F.size(hits) > 0, _let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("pieces")), measured)).otherwise(F.array().cast(_SPAN))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def _leading(spans: Column, test) -> Column:
    """How many of ``spans`` come before the first that fails ``test``, by halving; where one fails, all after it do."""
    n = F.size(spans)

    def step(at: Column, k: Column) -> Column:
        then = at + F.call_function("shiftleft", F.lit(1), k)
        return F.when((then <= n) & test(F.get(spans, then - 1)), then).otherwise(at)

    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.length(F.bin(n)) - 1, F.lit(0), F.lit(-1)), F.lit(0), step))


def _touches(c: Column, spans: Column) -> Column:
    """Whether a span overlaps one of ``spans``, which are in order and apart from each other."""
    return F.coalesce(F.get(spans, _leading(spans, lambda s: s["end"] <= c["start"]))["start"] < c["end"], F.lit(False))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda c: F.try_to_number(c, F.lit("9")).cast("int"))
    figures = F.filter(figures, lambda c: c.isNotNull())
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _kept(kind: str, value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.char_length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.lpad(F.ltrim(p, F.lit("0")), 3, "0") <= "255"))
    if kind == "card":
        return F.char_length(value).between(13, 37) & F.char_length(digits).between(13, 19) & luhn(digits)
    if kind == "phone":
        return F.char_length(digits).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """The four kinds' strict matches: array of (kind number, start, end, value, before, after)."""

    def of(n: int, kind: str) -> Column:
        found = F.filter(matches(text, PATTERNS[kind]), lambda m: _kept(kind, m["value"]))
        return F.transform(found, lambda m: F.struct(F.lit(n).alias("kind"), *[m[c].alias(c) for c in ("start", "end", "value", "before", "after")]))

    return F.concat(*[of(n, kind) for n, kind in enumerate(KINDS)])


def candidates(text: Column) -> Column:
    """Token runs and digit groups that may be identifiers; one that is both counts once."""
    figures = lambda m: F.char_length(F.regexp_replace(m["value"], "[^0-9]", ""))
    groups = F.filter(matches(text, GROUPS), lambda m: figures(m).between(7, 19))

    def joined(both: Column) -> Column:
        def known(g: Column) -> Column:
            r = F.get(both["runs"], _leading(both["runs"], lambda r: r["start"] < g["start"]))
            return F.coalesce((r["start"] == g["start"]) & (r["end"] == g["end"]), F.lit(False))

        told = lambda found, group: F.transform(found, lambda m: F.struct(*[m[c].alias(c) for c in ("start", "end", "value", "before", "after")], F.lit(group).alias("group")))
        return F.concat(told(both["runs"], False), told(F.filter(both["groups"], lambda g: ~known(g)), True))

    return _let(F.struct(matches(text, CANDIDATE).alias("runs"), groups.alias("groups")), joined)


def _shape_fits(kind: Column, value: Column) -> Column:
    digits = F.char_length(F.regexp_replace(value, "[^0-9]", ""))
    letters = value.rlike("[A-Za-z@_%+]")
    return (
        F.when(kind == 0, value.rlike(r"^[^@]+@[^@]+$"))
        .when(kind == 1, value.rlike(r"^[0-9]{1,3}([.-][0-9]{1,3}){3}$"))
        .when(kind == 2, ~letters & digits.between(12, 19))
        .otherwise(~value.rlike("[A-Za-z@_%]") & digits.between(7, 15))
    )


def _contexts(before: Column, after: Column) -> Column:
    left = F.regexp_extract(F.lower(before), r"([^ \t-\r]+)[ \t-\r]*$", 1)
    two = F.regexp_extract(F.lower(before), r"([^ \t-\r]+[ \t-\r]+[^ \t-\r]+)[ \t-\r]*$", 1)
    right = F.regexp_extract(F.lower(after), r"^[ \t-\r]*([^ \t-\r]+)", 1)
    both = F.array(
        F.when(left != "", F.concat(F.lit("l "), left)),
        F.when(two != "", F.concat(F.lit("ll "), two)),
        F.when((left != "") & (right != ""), F.concat_ws(" ", F.lit("lr"), left, right)),
        F.when(right != "", F.concat(F.lit("r "), right)),
    )
    return F.array_compact(both)


def find_private(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Spans of personal data in every whole text: (doc_id, *keep, base, added), arrays of (kind, start, end, value).

    kind is a number in KINDS, places are code points with the end exclusive. ``base`` has the strict
    matches; ``added`` what the patterns found besides, never overlapping a base span. Null and empty
    texts have none; nulls and repeats of the id are rows of their own; an empty table gives no rows;
    repeated rows give the same spans each; columns in ``keep`` pass through, others are ignored.
    """
    spark = documents.sparkSession
    saved = Saved(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    kept_cols = [F.col(c).alias(f"keep_{c}") for c in keep]
    rows = documents.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), *kept_cols, base_spans(text).alias("base"), candidates(text).alias("cand"))

    def free(x: Column) -> Column:
        """Candidates that touch no base span; each kind's spans are in order."""
        return F.filter(x["cand"], lambda c: ~reduce(lambda a, b: a | b, [_touches(c, x[kind]) for kind in KINDS]))

    of = lambda n: F.filter("base", lambda s: s["kind"] == n)
    clear = _let(F.struct(F.col("cand"), *[of(n).alias(kind) for n, kind in enumerate(KINDS)]), free)
    rows = rows.withColumn("cand", F.when((F.size("base") == 0) | (F.size("cand") == 0), F.col("cand")).otherwise(clear))
    rows = saved.save(rows)
    seeds = rows.select(F.explode("base").alias("s")).select("s.kind", F.lower("s.value").alias("value"), F.explode(_contexts(F.col("s.before"), F.col("s.after"))).alias("pattern"), F.lit(True).alias("seed"))
    cands = rows.select(F.explode("cand").alias("s")).select(F.lit(None).cast("int").alias("kind"), F.lower("s.value").alias("value"), F.explode(_contexts(F.col("s.before"), F.col("s.after"))).alias("pattern"), F.lit(False).alias("seed"))
    graph = saved.save(seeds.union(cands).distinct())
    instances = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n_instances"))
    # no round trusts a value by more than 1: a pattern's support is at most its seeds and fitting candidates of one kind
    kinds = F.explode(F.when(F.col("seed"), F.array("kind")).otherwise(F.filter(F.array(*map(F.lit, range(len(KINDS)))), lambda k: _shape_fits(k, F.col("value")))))
    reach = graph.select("pattern", "value", kinds.alias("kind")).groupBy("pattern", "kind").agg(F.countDistinct("value").alias("n"))
    lively = reach.join(instances, "pattern").where((F.col("n") >= min_support) & (F.col("n") / F.col("n_instances") >= min_confidence)).select("pattern").distinct()
    graph = saved.save(graph.join(lively, "pattern", "left_semi"))
    instances = graph.groupBy("pattern").agg(F.countDistinct("value").alias("n_instances"))
    trusted = graph.where("seed").select("kind", "value", F.lit(1.0).alias("trust")).distinct()
    edges = graph.select("pattern", "value").distinct()
    unseen = graph.where(~F.col("seed")).select("pattern", "value").distinct()
    for _ in range(rounds):
        support = edges.join(trusted, "value").groupBy("pattern", "kind").agg(F.sum("trust").alias("support"))
        good = support.join(instances, "pattern").select("pattern", "kind", "support", (F.col("support") / F.col("n_instances")).alias("conf")).where((F.col("support") >= min_support) & (F.col("conf") >= min_confidence))
        found = unseen.join(good.select("pattern", "kind", "conf"), "pattern").where(_shape_fits(F.col("kind"), F.col("value")))
        found = found.groupBy("kind", "value").agg(F.least(F.lit(0.999999), 1 - F.exp(F.sum(F.log1p(-F.least(F.col("conf"), F.lit(0.999999)))))).alias("trust"))
        seeds_too = graph.where("seed").select("kind", "value", F.lit(1.0).alias("trust")).union(found.where(F.col("trust") >= min_confidence))
        trusted = saved.save(seeds_too.groupBy("kind", "value").agg(F.max("trust").alias("trust")))  # a seed counts once
    best = trusted.where("trust < 1.0").groupBy("value").agg(F.max_by("kind", F.struct("trust", -F.col("kind"))).alias("kind"))
    occurrences = rows.select("row", F.explode("cand").alias("c")).withColumn("value", F.lower("c.value"))
    occurrences = occurrences.join(best, "value").groupBy("row").agg(F.sort_array(F.collect_list(F.struct(F.col("c.start").alias("start"), F.col("c.end").alias("end"), F.col("c.value").alias("value"), "kind", F.col("c.group").alias("group")))).alias("all"))

    def outer(x: Column) -> Column:
        """A part of a longer one is not told again; runs are in order and apart from each other, and so are groups."""

        def inside(c: Column, spans: Column) -> Column:
            b = F.get(spans, _leading(spans, lambda s: s["end"] < c["end"]))
            return F.coalesce((b["start"] <= c["start"]) & (c["end"] - c["start"] < b["end"] - b["start"]), F.lit(False))

        kept = F.filter(x["all"], lambda c: ~(inside(c, x["runs"]) | inside(c, x["groups"])))
        return F.transform(kept, lambda c: F.struct(*[c[k].alias(k) for k in ("kind", "start", "end", "value")]))

    families = F.struct("all", F.filter("all", lambda c: ~c["group"]).alias("runs"), F.filter("all", lambda c: c["group"]).alias("groups"))
    added = saved.save(occurrences.select("row", F.sort_array(_let(families, outer)).alias("added")))
    few = (added.agg(F.sum(F.size("added"))).first()[0] or 0) <= MAX_ADDED
    plain = "array<struct<kind:int,start:int,end:int,value:string>>"
    base = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    out = rows.join(F.broadcast(added) if few else added, "row", "left")
    return out.select("doc_id", *[F.col(f"keep_{c}").alias(c) for c in keep], base.alias("base"), F.coalesce("added", F.array().cast(plain)).alias("added"))


def span_text(spans: Column) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(F.sort_array(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def redact(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of overlapping spans the first one stands.

    The text is cut into chunks first, so that no part of it is looked for from the text's beginning.
    """
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def first_ones(all_: Column) -> Column:
        """Numbers of the spans that stand, block by block."""

        def step(acc: Column, i: Column) -> Column:
            s = F.get(all_, i)
            return F.when(s["start"] >= acc["at"], F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(i)).alias("out"))).otherwise(acc)

        def block(acc: Column, b: Column) -> Column:
            places = F.sequence(b * BLOCK, F.least(b * BLOCK + (BLOCK - 1), F.size(all_) - 1))
            done = F.aggregate(places, F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], d["out"]).alias("out")))

        none = F.array().cast("array<int>")
        blocks = F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / BLOCK).cast("int"))
        kept = F.aggregate(blocks, F.struct(F.lit(0).alias("at"), none.alias("out")), block, lambda acc: acc["out"])
        return F.transform(kept, lambda i: F.get(all_, i))

    def joined(x: Column) -> Column:
        size, chunks, kept = x["size"], x["chunks"], x["kept"]

        def part(a: Column, b: Column) -> Column:
            def of(k: Column) -> Column:
                low = F.greatest(a - k * size, F.lit(0))
                return F.substring(F.get(chunks, k), low + 1, F.least(b - k * size, size) - low)

            return F.when(b <= a, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.floor(a / size).cast("int"), F.floor((b - 1) / size).cast("int")), of), ""))

        pieces = F.transform(kept, lambda s, i: F.concat(part(F.when(i > 0, F.get(kept, i - 1)["end"]).otherwise(F.lit(0)), s["start"]), F.get(names, s["kind"])))
        return F.concat(F.array_join(pieces, ""), part(F.element_at(kept, -1)["end"], x["n"]))

    n = F.char_length(text)
    size = F.greatest(F.lit(4096), F.ceil(n / 512).cast("int"))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda k: F.substring(text, k * size + 1, size))
    done = _let(F.struct(n.alias("n"), size.alias("size"), chunks.alias("chunks"), _let(ordered, first_ones).alias("kept")), joined)
    return F.when(F.size(spans) == 0, text).otherwise(done)


def op3_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = find_private(table(spark, sf_dir, "documents"))
    count = lambda n: F.size(F.filter("base", lambda s: s["kind"] == n)).cast("long")
    return rows.select(
        "doc_id",
        *[count(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS)],
        F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.concat("base", "added")).alias("spans"),
    )
