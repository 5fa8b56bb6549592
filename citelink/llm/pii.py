"""Personal data: fixed patterns as seeds, and contexts learned from them that find further identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelink.sources.scratch import stored

KINDS = ("email", "ip", "card", "phone")

# The seed patterns. The look-behinds only skip starts that cannot match, and possessive loops only what
# would be tried in vain, so that long runs without a match take linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold before a seed pattern is tried on it: a string, and a pattern.
HINT = {
    "email": ("@", r"@[A-Za-z0-9-]"),
    "ip": (".", r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9]){15}"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]"),
}
_W = r"\x20\x09-\x0D"
#: A run of tokens, one blank apart, that may be an identifier, since each of them holds a digit or an @.
RUN = rf"(?<![^{_W}])[^{_W}0-9@]*+[0-9@][^{_W}]*+(?:\x20[^{_W}0-9@]*+[0-9@][^{_W}]*+)*+"
#: Punctuation that is taken off both ends of a learned identifier.
TRIM = "\"'`.,;:!?()[]{}<>*#%&$="
#: The same at the left end, but for the bracket of an area code.
LEFT = r"^(?:(?!\([0-9]{1,5}\))[" + TRIM.replace("[", r"\[").replace("]", r"\]") + "])++"
ROUNDS = 3
#: A pattern needs so many different sure values and this confidence, an identifier this one.
MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 5, 0.8, 0.9
#: Weight of the doubt that every pattern starts with, in occurrences, and of an occurrence that fits a kind and is not known to be of it.
DOUBT, UNKNOWN = 0.5, 0.2


def _pieces(text: Column, pattern: str) -> Column:
    """For each match in order: the code points since the last one, and what it holds."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(values))
    return F.zip_with(gaps, values, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value")))


def _with_neighbours(text: Column) -> Column:
    """For each run in order: the code points since the last one, what it holds, the two words before it and the word after it."""
    found = F.array(F.struct(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)).alias("values"), F.split(text, RUN, -1).alias("gaps")))

    def word(c: Column) -> Column:
        bare = F.rtrim(F.ltrim(F.lower(c), F.lit(TRIM)), F.lit(TRIM))
        return F.when(bare != "", bare).otherwise(c)

    def each(x: Column) -> Column:
        def one(v: Column, i: Column) -> Column:
            # what comes before is read from its end, so that each search begins at a text's start and takes linear time
            back, ahead = F.reverse(F.get(x["gaps"], i)), F.get(x["gaps"], i + 1)
            first_two = rf"^[{_W}]*+([^{_W}]++)(?:[{_W}]++([^{_W}]++))?"
            l2, l1 = (word(F.reverse(F.regexp_extract(back, first_two, k))) for k in (2, 1))
            return F.struct(F.length(F.get(x["gaps"], i)).alias("gap"), v.alias("value"), l2.alias("l2"), l1.alias("l1"), word(F.regexp_extract(ahead, first_two, 1)).alias("r1"))

        return F.transform(x["values"], one)

    return F.element_at(F.transform(found, each), 1)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum of card numbers."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(values, lambda d, i: F.when(i % 2 == 0, d).otherwise((d * 2) % 10 + F.floor(d / 5).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: Column, value: Column) -> Column:
    """The test that a match of each kind has to pass."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    part = F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.regexp_replace(p, "^0+(?=[0-9])", "").try_cast("bigint"), F.lit(256)) <= 255)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", part)
        .when(kind == "card", F.length(digits).between(16, 19) & luhn(digits))
        .otherwise(F.length(digits).between(8, 15))
    )


def _searched(docs: DataFrame) -> DataFrame:
    """(row, doc_id, email, ip, card, phone, token): the pieces of each row's matches and of its runs, one pass over the texts."""
    text = F.coalesce("text", F.lit(""))
    none = F.array().cast("array<struct<gap:int,value:string>>")
    columns = []
    for kind in KINDS:
        holds, hint = HINT[kind]
        here = text.rlike(hint) if not holds else text.contains(holds) & text.rlike(hint)
        columns.append(F.when(here, _pieces(text, BASE[kind])).otherwise(none).alias(kind))
    columns.append(F.when(text.rlike("[0-9@]"), _with_neighbours(text)).alias("token"))
    return stored(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", *columns), "searched")


def _ends(flat: DataFrame, by: list[str]) -> DataFrame:
    """``flat`` (at, m) with ``start`` and ``end`` of each match in code points, from the gaps and lengths up to it."""
    so_far = Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(F.col("m.gap") + F.length("m.value")).over(so_far).cast("int")
    return flat.withColumn("end", end).withColumn("start", F.col("end") - F.length("m.value"))


def _placed(searched: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of all matches of the seed patterns."""
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("pieces")) for k in KINDS)))
    flat = searched.where(" or ".join(f"size({k}) > 0" for k in KINDS)).select("row", each.alias("k")).select("row", "k.kind", F.posexplode("k.pieces").alias("at", "m"))
    return _ends(flat, ["row", "kind"]).select("row", "kind", "start", "end", F.col("m.value").alias("value"))


def fits(value: Column, kind: Column) -> Column:
    """Whether a value could be of a kind at all, whatever its exact form: all that a learned value is asked of its own characters."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return (
        F.when(kind == "email", value.rlike(rf"^[^@{_W}]+@[^@{_W}]+$"))
        .when(kind == "ip", value.rlike(r"^[0-9A-Fa-f]*(?:[.:][0-9A-Fa-f]*){3,}$"))
        .when(kind == "card", value.rlike(r"^[0-9][0-9 -]*[0-9]$") & digits.between(12, 19))
        .otherwise(value.rlike(r"^[+(]?[0-9][0-9().\x20/-]*[0-9]$") & digits.between(7, 15))
    )


def occurrences(searched: DataFrame, base: DataFrame) -> DataFrame:
    """(row, start, end, patterns, value, kind, taken) of runs of tokens, with the lexical patterns that they occur in.

    Patterns are the word before, the two words before, the words on both sides, and the word after. ``kind`` and ``value`` are the seed's where one
    begins in the run, which then has the words only on the sides that the seed reaches; ``taken`` says that a seed overlaps it. Runs inside
    a seed that began earlier are left out.
    """
    raw = _ends(searched.where("size(token) > 0").select("row", F.posexplode("token").alias("at", "m")), ["row"]).select("row", "end", "m.value", "m.l2", "m.l1", "m.r1")
    left = F.regexp_replace("value", LEFT, "")
    bare = F.rtrim(left, F.lit(TRIM))
    end = F.col("end") - F.length(left) + F.length(bare)
    runs = raw.select("row", (end - F.length(bare)).alias("start"), end.alias("end"), bare.alias("value"), "l2", "l1", "r1", F.lit(None).cast("string").alias("seed")).where("value <> ''")
    none = F.lit("")
    both = runs.unionByName(base.select("row", "start", "end", "value", none.alias("l2"), none.alias("l1"), none.alias("r1"), F.col("kind").alias("seed")))
    seed = F.when(F.col("seed").isNotNull(), F.struct("start", "end", "seed", "value"))
    order = Window.partitionBy("row").orderBy("start", F.col("seed").isNull(), "end")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    reach = F.max(F.when(F.col("seed").isNotNull(), F.struct("end", "start", "seed", "value"))).over(before)
    seen = both.withColumn("_back", reach).withColumn("_next", F.first(seed, ignorenulls=True).over(after)).where("seed is null")
    starts_here = F.when(F.col("_back.start") == F.col("start"), F.col("_back")).otherwise(F.when(F.col("_next.start") < F.col("end"), F.struct("_next.end", "_next.start", "_next.seed", "_next.value")))
    inside = (F.col("_back.end") > F.col("start")) & (F.col("_back.start") < F.col("start"))
    named = seen.where(F.coalesce(~inside, F.lit(True))).withColumn("_own", starts_here)
    at_start = F.coalesce(F.col("_own.start") == F.col("start"), F.lit(True)) & (F.col("l1") != "")
    at_end = F.coalesce(F.col("_own.end") == F.col("end"), F.lit(True)) & (F.col("r1") != "")
    patterns = F.array(
        F.when(at_start, F.concat(F.lit("1|"), "l1")), F.when(at_start & (F.col("l2") != ""), F.concat(F.lit("2|"), "l2", F.lit(" "), "l1")), F.when(at_start & at_end, F.concat(F.lit("b|"), "l1", F.lit("|"), "r1")), F.when(at_end, F.concat(F.lit("r|"), "r1"))
    )
    return named.select("row", "start", "end", F.filter(patterns, lambda x: x.isNotNull()).alias("patterns"), F.coalesce("_own.value", "value").alias("value"), F.col("_own.seed").alias("kind"), F.col("_own").isNotNull().alias("taken"))


def learned(found: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS) -> tuple[DataFrame, DataFrame]:
    """Sure patterns (pattern, kind, confidence) and values (value, kind, sure), from the occurrences.

    Patterns and values are the two sides of a graph whose edges count occurrences. A seed is sure of its kind. A pattern's confidence in a
    kind weighs its sure values of that kind against values that cannot be of it and, lightly, those that could; it
    speaks once enough different values stand behind it. Another value is as sure as its patterns make it together, if its characters fit the kind. Values found sure help
    patterns in the next round, so contexts that few seeds have can still be learned.
    """
    edges = stored(found.select(F.explode("patterns").alias("pattern"), "value", "kind").groupBy("pattern", "value").agg(F.count("*").alias("n"), F.max("kind").alias("kind")), "edges")
    seeds = edges.where("kind is not null").select("value", "kind").distinct().withColumn("sure", F.lit(1.0))
    could = [F.sum(F.when(fits(F.col("value"), F.lit(k)), F.col("n")).otherwise(0)).alias(f"fit_{k}") for k in KINDS]
    total = edges.groupBy("pattern").agg(F.sum("n").alias("total"), *could, F.count("*").alias("many")).where(F.col("many") >= min_seeds).drop("many")
    live = stored(edges.join(total, "pattern"), "live")
    sure = seeds
    for _ in range(rounds):
        mass = live.drop("kind").join(sure, "value").groupBy("pattern", "kind").agg(F.sum(F.col("n") * F.col("sure")).alias("mass"), F.sum("sure").alias("behind"), F.max("total").alias("total"), *(F.max(f"fit_{k}").alias(f"fit_{k}") for k in KINDS))
        fit = F.coalesce(*(F.when(F.col("kind") == k, F.col(f"fit_{k}")) for k in KINDS))
        against = F.col("total") - fit + UNKNOWN * F.greatest(fit - F.col("mass"), F.lit(0.0)) + DOUBT
        scored = mass.where(F.col("behind") >= min_seeds).select("pattern", "kind", (F.col("mass") / (F.col("mass") + against)).alias("confidence"))
        patterns = stored(scored.where(F.col("confidence") >= MIN_PATTERN), "patterns")
        others = live.where("kind is null").drop("kind").join(patterns, "pattern").where(fits(F.col("value"), F.col("kind")))
        guess = others.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("confidence"), F.lit(0.999)))))).alias("sure"))
        sure = stored(seeds.unionByName(guess.where(F.col("sure") >= MIN_INSTANCE)), "sure")
    return patterns, sure


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, spans array<(rank, start, end, kind, seed boolean)>) for each row of (doc_id, text), in order of kind and start.

    Offsets are code points, the end exclusive. Seeds are the leftmost matches of the fixed patterns that don't overlap and pass
    their kind's test. Learned spans are whole runs of tokens without surrounding punctuation that overlap no seed. A null or empty
    text has none. Each row is searched for itself, so rows that repeat have the same spans each.
    """
    searched = _searched(docs.select("doc_id", "text"))
    base = stored(_placed(searched).where(valid(F.col("kind"), F.col("value"))), "base")
    found = stored(occurrences(searched, base), "occurrences")
    patterns, sure = learned(found, rounds)
    fresh = found.where(~F.col("taken")).select("row", "start", "end", F.explode("patterns").alias("pattern"), "value").join(patterns, "pattern").join(sure, ["value", "kind"])
    best = fresh.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int")
    spans = base.select("row", rank.alias("rank"), "start", "end", "kind", F.lit(True).alias("seed")).unionByName(best.select("row", rank.alias("rank"), "start", "end", "kind", F.lit(False).alias("seed")))
    by_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("rank", "start", "end", "kind", "seed"))).alias("spans"))
    return searched.select("row", "doc_id").join(by_row, "row", "left").select("doc_id", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"))


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: the seeds counted and digested, and all spans."""
    found = find_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def seeds_of(kind: str) -> Column:
        return F.filter("spans", lambda s: s["seed"] & (s["kind"] == kind))

    seeds = F.filter("spans", lambda s: s["seed"])
    counts = [F.size(seeds_of(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(seeds).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
