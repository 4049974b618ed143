"""PII: bootstrapped contextual extraction.

Seed entities are what the base patterns find (email, ip, card, phone). They induce lexical patterns,
the words around them in lower case with digits masked: the word on either side, the two words before,
the two words after. A pattern is kept if at least ``support`` different seeds stand in it and if they are
at least ``floor`` of all that stands in it anywhere in the corpus, ordinary words included.

What stands in a kept pattern, any run of non-space without the punctuation around it, is an
instance. Spark scores the pattern-instance graph in rounds:

    pattern   = confidence of its occurrences / (occurrences + 1)
    instance  = 1 for a seed, else (1 - product of (1 - score) over its patterns) * its occurrences in
                kept patterns / its occurrences in the corpus

so that what good patterns surround lends confidence to further patterns, and a word that also
stands elsewhere does not. An occurrence of an instance is reported (kind ``context``) if one of
its patterns and the instance reach ``confidence``. Base spans are always reported.

Everything is a DataFrame expression: no Python runs on the executors. Patterns and instances are
counted with map-side combining, and the joins with them are plain equi-joins on written tables, which
skew handling may split.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import count_kind, no_spans, regex_spans, rendered

# Fixed patterns of the contract. Possessive repeats and the look-behinds change no match
# (no start inside a run can match where the run's first does not); they keep the matcher
# linear and off the stack on very long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Inside seeds the characters are moved to a private range, letter by letter, so that a seed is one run of
# non-space, keeps its length and its identity, and is told from all else.
ASCII = "".join(map(chr, range(0x20, 0x7F)))
PRIVATE = "".join(chr(0xE000 + ord(c)) for c in ASCII)
SEED = "[\ue020-\ue07e]"
# Where characters go that stand in that range already, so that none is taken for a part of a seed.
FAR = "".join(chr(0xF700 + ord(c)) for c in ASCII)
SPACE = r"[\x20\x09-\x0D]+"
# The punctuation around a value
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# Bounds of the shares of the rows in which patterns are counted, of 64: a 64th, seven, the rest
SHARES = (0, 1, 8, 64)
# Bits of the table that tells patterns apart before the join
SIEVE = 2**18
KINDS = ["email", "ip", "card", "phone", "context"]


@dataclass(frozen=True)
class PiiConfig:
    rounds: int = 3
    support: int = 3  # different seeds of a pattern
    floor: float = 0.2  # seeds among all that stands in a pattern
    confidence: float = 0.5


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    weighted = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(weighted, F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    email = regex_spans(text, "email", EMAIL, F.contains(text, F.lit("@")))
    ip = F.filter(
        regex_spans(text, "ip", IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")),
        lambda s: F.forall(F.split(s["value"], r"\."), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False))),
    )
    card = F.filter(
        regex_spans(text, "card", CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        lambda s: F.when(F.length(_digits(s["value"])).between(13, 19), luhn(_digits(s["value"]))).otherwise(False),
    )
    phone = F.filter(regex_spans(text, "phone", PHONE, text.rlike(r"\+[0-9]")), lambda s: F.length(_digits(s["value"])).between(9, 15))
    return F.concat(email, ip, card, phone)


def masked(text: Column, base: Column) -> Column:
    """The text with its seeds in the private range; places and length stay."""
    return F.aggregate(base, text, lambda t, s: F.overlay(t, F.translate(s["value"], ASCII, PRIVATE), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, base, marked: one row per input row, written to the shared folder; ``marked`` is the
    masked text of rows with seeds, null elsewhere. Null texts are empty. Private-use characters of a
    text that lie in the range of the seeds are first moved to another one; places and lengths stay."""
    step = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = F.when(F.col("text").rlike(SEED), F.translate("text", PRIVATE, FAR)).otherwise(F.col("text"))
    step = step.withColumn("base", base_spans(F.col("text"))).withColumn("text", own)
    return materialize(step.select("row_id", "doc_id", "text", "base", F.when(F.size("base") > 0, masked(F.col("text"), F.col("base"))).alias("marked")), "pii-scan")


def _words(scanned: DataFrame) -> DataFrame:
    """row_id and the words of every masked text, as they are and as they stand in patterns."""
    text = F.btrim(F.coalesce("marked", "text"), F.lit(" \t\n\x0b\f\r"))
    plain = F.regexp_replace(F.regexp_replace(F.lower("t"), SEED + "+", "@"), "[0-9]+", "0")
    return scanned.select("row_id", text.alias("t")).where("t <> ''").select("row_id", F.split("t", SPACE).alias("w"), F.split(plain, SPACE).alias("f"))


def value_of(word: Column) -> Column:
    return F.btrim(word, F.lit(EDGES))


def sieve(patterns: DataFrame) -> Column:
    """Bit table of pattern hashes as a constant, 2^18 bits whatever their number: it tells most patterns of the corpus
    from those looked for before a row is made of them. The join behind it decides."""
    words = SIEVE // 64
    spot = F.col("pattern").bitwiseAND(F.lit(SIEVE - 1))
    each = patterns.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pattern").bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    bits = {r["at"]: r["bits"] for r in each.collect()}  # at most ``words`` rows
    return F.split(F.lit(",".join(str(bits.get(i, 0)) for i in range(words))), ",").cast("array<bigint>")


def occurrences(scanned: DataFrame, bits: Column | None = None) -> DataFrame:
    """row_id, i, word, pattern: every word of the corpus in each of its patterns, which are hashes of kind and
    words; with a ``sieve`` only what passes it. Never written as such."""
    none, f, n = F.lit(None).cast("string"), F.col("f"), F.size("f")
    before = lambda k: F.concat(F.array(*[none] * k), F.slice(f, F.lit(1), F.greatest(n - k, F.lit(0))))
    lined = F.arrays_zip(F.col("w"), before(2).alias("b2"), before(1).alias("b1"), F.slice(f, F.lit(2), n).alias("a1"), F.slice(f, F.lit(3), n).alias("a2"))
    each = _words(scanned).select("row_id", F.posexplode(lined).alias("i", "x")).where("x.w is not null")
    two = lambda kind, a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.xxhash64(F.lit(kind), a, b))
    each = each.select("row_id", "i", F.col("x.w").alias("word"), two("around", "x.b1", "x.a1").alias("p0"), two("before", "x.b2", "x.b1").alias("p1"), two("after", "x.a1", "x.a2").alias("p2"))
    names = ["p0", "p1", "p2"]
    if bits is not None:
        passes = lambda p: F.getbit(F.get(bits, F.shiftright(F.col(p).bitwiseAND(F.lit(SIEVE - 1)), 6).cast("int")), F.col(p).bitwiseAND(F.lit(63)).cast("int")) == 1
        each = each.withColumns({p: F.when(passes(p), F.col(p)) for p in names}).where(F.coalesce(*names).isNotNull())
    return each.select("row_id", "i", "word", F.explode(F.array(*names)).alias("pattern")).where("pattern is not null")


def kept_occurrences(scanned: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """row_id, i, word, pattern: what stands in patterns of enough seeds and enough of all that stands in them.
    Occurrences are looked for in three disjoint shares of the rows, the smallest first. What a pattern has in some rows
    it has at least in all, so one that is below ``floor`` by then is below it in the end and isn't looked for in the
    rest: the many patterns that chance induces between frequent words meet the smallest share only, every text is
    taken apart once, and the result is that of one count over all rows."""
    seeded = occurrences(scanned.where("marked is not null")).where(F.col("word").rlike(SEED))
    induced = seeded.groupBy("pattern", F.regexp_extract("word", SEED + "+", 0).alias("seed")).agg(F.count("*").alias("n"))
    induced = induced.groupBy("pattern").agg(F.count("*").alias("seeds"), F.sum("n").alias("n")).where(F.col("seeds") >= cfg.support)
    left = materialize(induced.select("pattern", "n", F.lit(0).cast("long").alias("all")), "pii-induced")
    share = F.pmod(F.xxhash64("row_id"), F.lit(SHARES[-1]))
    found = None
    for low, high in zip(SHARES, SHARES[1:]):
        here = occurrences(scanned.where((share >= low) & (share < high)), sieve(left)).join(left.select("pattern"), "pattern", "left_semi")
        here = materialize(here.select("row_id", "i", "word", "pattern"), "pii-found")
        more = here.groupBy("pattern").agg(F.count("*").alias("more"))
        total = left.join(more, "pattern", "left").select("pattern", "n", (F.col("all") + F.coalesce("more", F.lit(0))).alias("all"))
        left = materialize(total.where(F.col("n") >= cfg.floor * F.col("all")), "pii-patterns")
        found = here if found is None else found.unionByName(here)
    return found.join(left.select("pattern"), "pattern", "left_semi")


def graph(scanned: DataFrame, cfg: PiiConfig = PiiConfig()) -> tuple[DataFrame, DataFrame]:
    """(row_id, i, value, seed, pattern): what stands in kept patterns; (value, all): how often the values
    that are not seeds stand anywhere."""
    found = kept_occurrences(scanned, cfg)
    seed = F.col("word").rlike(SEED)
    found = found.select("row_id", "i", F.when(seed, F.regexp_extract("word", SEED + "+", 0)).otherwise(value_of(F.col("word"))).alias("value"), seed.alias("seed"), "pattern")
    found = materialize(found.where("value <> ''"), "pii-graph")
    names = materialize(found.where("not seed").select("value").distinct(), "pii-names")
    words = _words(scanned).select(F.explode("w").alias("word")).select(value_of(F.col("word")).alias("value"))
    return found, materialize(words.join(names, "value", "left_semi").groupBy("value").agg(F.count("*").alias("all")), "pii-background")


def scores(found: DataFrame, background: DataFrame, cfg: PiiConfig = PiiConfig()) -> tuple[DataFrame, DataFrame]:
    """(pattern, score) and (value, seed, confidence) after the last round."""
    edges = found.groupBy("pattern", "value", "seed").agg(F.count("*").alias("n"))
    edges = materialize(edges, "pii-edges")
    inside = found.where("not seed").groupBy("value").agg(F.countDistinct("row_id", "i").alias("inside"))
    weight = materialize(inside.join(background, "value").select("value", (F.col("inside") / F.col("all")).alias("weight")), "pii-weights")
    values = edges.select("value", "seed", F.col("seed").cast("double").alias("confidence")).distinct()
    for _ in range(cfg.rounds):
        patterns = edges.join(values, ["value", "seed"]).groupBy("pattern").agg((F.sum(F.col("n") * F.col("confidence")) / (F.sum("n") + 1)).alias("score"))
        patterns = materialize(patterns, "pii-scores")
        # 1 - product by logarithms; scores stay below 1 because of the + 1 above
        near = edges.join(patterns, "pattern").groupBy("value", "seed").agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("c")).join(weight, "value", "left")
        values = materialize(near.select("value", "seed", F.when(F.col("seed"), 1.0).otherwise(F.col("c") * F.coalesce("weight", F.lit(0.0))).alias("confidence")), "pii-values")
    return patterns, values


def discovered(scanned: DataFrame, cfg: PiiConfig = PiiConfig()) -> DataFrame:
    """row_id, extra: spans of the instances that high-confidence patterns bring out."""
    found, background = graph(scanned, cfg)
    patterns, values = scores(found, background, cfg)
    good = patterns.where(F.col("score") >= cfg.confidence).select("pattern")
    sure = values.where((F.col("confidence") >= cfg.confidence) & ~F.col("seed")).select("value")
    hits = found.where("not seed").join(good, "pattern", "left_semi").join(sure, "value", "left_semi").groupBy("row_id").agg(F.array_sort(F.collect_set("i")).alias("hits"))
    hits = materialize(hits, "pii-hits")
    # places of the words, only in rows with a hit: the length of the gaps and words before each
    rows = scanned.select("row_id", F.coalesce("marked", "text").alias("t")).join(hits, "row_id")
    word = r"[^\x20\x09-\x0D]+"
    rows = rows.select("row_id", "hits", F.regexp_extract_all("t", F.lit(word), F.lit(0)).alias("w"), F.split("t", word, -1).alias("g"))
    size = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x))

    def span(i):
        own = F.get(F.col("w"), i)
        lead = F.length(own) - F.length(F.ltrim(own, F.lit(EDGES)))
        start = size(F.slice("g", 1, i + 1)) + size(F.slice("w", 1, i)) + lead
        value = value_of(own)
        return F.struct(F.lit("context").alias("kind"), start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"))

    return rows.select("row_id", F.transform("hits", span).alias("extra"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, null and repeated ids included. Null and empty texts have no spans;
    very long texts are read whole; an empty table gives an empty result; other columns are not read."""
    scanned = scan(table(spark, sf_dir, "documents"))
    out = scanned.join(discovered(scanned), "row_id", "left").withColumn("extra", F.coalesce("extra", no_spans()))
    return out.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]),
        F.sha2(rendered(F.col("base"), KINDS, True), 256).alias("base_sha256"),
        rendered(F.concat("base", "extra"), KINDS, True).alias("spans"),
        F.size("extra").cast("long").alias("n_context"),
    )
