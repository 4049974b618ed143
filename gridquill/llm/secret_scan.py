"""Secret scans by corpus-wide ownership frequency.

Patterns give candidates in every text: assignments to secret-like names, access keys, long
hexadecimal runs (the base kinds), and ``opaque`` runs of 20 or more of [A-Za-z0-9+/_-] holding
a digit and letters of both cases outside the base spans. The value of every candidate is hashed
and the hashes of the whole corpus are aggregated by distinct repositories (here: documents) and
distinct owners (here: sources; a null source is an owner of its own). Both criteria go by the size of
a value's main owner, the one with most of its repositories (ties: the last name), in repositories that hold any candidate:

* *spread*: a value of more than ``MAX_OWNERS`` owners is a copied example, unless it belongs to its main
  owner: that one holds more than half of its repositories, and more than ``SIGMAS`` standard deviations
  above what a value copied at random would have there by the owner's share of all repositories.
* *copied within*: a value in more than ``MAX_REPOS`` repositories and more than the square root of the main
  owner's is an example, however few owners it has. The root lies between a constant, which calls every shared
  credential of a large owner an example, and a rate, which would let a third of a corpus pass as one.

What is neither looks live. Base spans are always reported; opaque ones only if they look live.

Everything is a DataFrame expression: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table
from .spans import count_kind, no_spans, regex_spans, rendered

# Fixed patterns of the contract
ASSIGN = r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"  # the maximal runs of at least 24
OPAQUE = r"[A-Za-z0-9+/_-]{20,}"
MAX_OWNERS, MAX_REPOS, SIGMAS = 2, 8, 3
KINDS = ["assign", "access", "hex", "opaque"]
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")


def _value(span: Column) -> Column:
    """What is hashed: of an assignment the assigned value."""
    return F.when(span["kind"] == "assign", F.regexp_extract(span["value"], ASSIGN, 2)).otherwise(span["value"])


def base_spans(text: Column) -> Column:
    lower = F.lower(text)
    named = F.lit(False)
    for n in NAMES:
        named = named | F.contains(lower, F.lit(n))
    assign = F.filter(regex_spans(text, "assign", ASSIGN, named), lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 2)) >= 6)
    access = F.filter(regex_spans(text, "access", ACCESS, F.contains(text, F.lit("AKIA"))), lambda s: F.length(s["value"]) >= 20)
    return F.concat(assign, access, regex_spans(text, "hex", HEX, text.rlike(HEX)))


def opaque_spans(text: Column, base: Column) -> Column:
    found = F.filter(regex_spans(text, "opaque", OPAQUE, text.rlike(OPAQUE)), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[a-z]") & s["value"].rlike("[A-Z]"))
    return F.filter(found, lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))


def scan(docs: DataFrame, owner_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row_id, doc_id, text_key, owner, base, opaque: one row per input row, written to the shared folder.

    Null texts are empty. Rows are told apart by row_id, so null and repeated ids stay separate;
    text_key is a hash of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.concat(F.lit("="), F.col(owner_col).cast("string")), F.lit("null")).alias("owner"), text.alias("text"))
    step = step.select("doc_id", "owner", "text", base_spans(F.col("text")).alias("base"))
    step = step.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", F.xxhash64("text").alias("text_key"), "owner", "base", opaque_spans(F.col("text"), F.col("base")).alias("opaque"))
    return materialize(step, "secret-scan")


def _hashed(scanned: DataFrame) -> DataFrame:
    each = scanned.select("row_id", "doc_id", "owner", F.explode(F.concat("base", "opaque")).alias("span"))
    return each.withColumn("value_hash", F.sha2(_value(F.col("span")), 256))


def ownership(scanned: DataFrame) -> DataFrame:
    """value_hash, n_repos, n_owners, main (n, owner) over the whole corpus. (hash, owner, document) is made
    distinct with map-side combining before it is counted, so a value copied everywhere does
    not land in one task. A document of several owners is a repository of each; null ids are one."""
    per_owner = _hashed(scanned).groupBy("value_hash", "owner", "doc_id").agg(F.lit(1).alias("one")).groupBy("value_hash", "owner").agg(F.count("*").alias("n"))
    return per_owner.groupBy("value_hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"), F.max(F.struct("n", "owner")).alias("main"))


def owner_sizes(scanned: DataFrame) -> DataFrame:
    """owner, size: its repositories that hold a candidate."""
    holding = scanned.where((F.size("base") > 0) | (F.size("opaque") > 0)).groupBy("owner", "doc_id").agg(F.lit(1).alias("one"))
    return holding.groupBy("owner").agg(F.count("*").alias("size"))


def verdicts(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS, sigmas: float = SIGMAS) -> DataFrame:
    """value_hash, n_repos, n_owners, spread, copied: a row per value; it looks live if neither holds."""
    own = materialize(ownership(scanned).select("value_hash", "n_repos", "n_owners", "main.*"), "secret-owners")
    sizes = materialize(owner_sizes(scanned), "secret-sizes")
    total = F.lit(sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]).cast("double")
    few = (F.col("n_owners") <= max_owners) & (F.col("n_repos") <= max_repos)
    # only values that are frequent enough ask for their owner's size
    asked = own.where(~few).join(sizes, "owner")
    size, k, n = F.col("size").cast("double"), F.col("n_repos").cast("double"), F.col("n").cast("double")
    above = n * total - k * size
    belongs = (2 * n > k) & (above > 0) & (above * above > sigmas * sigmas * k * size * (total - size))
    spread = (F.col("n_owners") > max_owners) & ~belongs
    copied = (F.col("n_repos") > max_repos) & (k * k > size)
    cols = ["value_hash", "n_repos", "n_owners"]
    return own.where(few).select(*cols, F.lit(False).alias("spread"), F.lit(False).alias("copied")).unionAll(asked.select(*cols, spread.alias("spread"), copied.alias("copied")))


def live_spans(scanned: DataFrame, max_owners: int = MAX_OWNERS, max_repos: int = MAX_REPOS) -> DataFrame:
    """row_id, live: the candidates (base and opaque) whose value looks owner-specific."""
    live = verdicts(scanned, max_owners, max_repos).where(~F.col("spread") & ~F.col("copied")).select("value_hash")
    # a live value has at most the square root of its owner's repositories, so no hash of ``live`` is hot; written, the occurrences and the
    # verdicts have exchanges of their own, which skew handling can split for the widely copied ones
    live = materialize(live, "secret-live")
    return _hashed(scanned).join(live, "value_hash", "left_semi").groupBy("row_id").agg(F.sort_array(F.collect_list("span")).alias("live"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per row of ``documents``, null and repeated ids included. Null and empty texts have no spans;
    very long texts are scanned whole; an empty table gives an empty result; other columns are not read."""
    scanned = scan(table(spark, sf_dir, "documents"))
    out = scanned.join(live_spans(scanned), "row_id", "left").withColumn("live", F.coalesce("live", no_spans()))
    every = F.concat("base", F.filter("live", lambda s: s["kind"] == "opaque"))
    return out.select(
        "doc_id",
        *(count_kind(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:3]),
        F.sha2(rendered(F.col("base"), KINDS, False), 256).alias("base_sha256"),
        rendered(every, KINDS, False).alias("spans"),
        F.size("live").cast("long").alias("n_live"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: no document goes; values that look live are masked in the texts (and
    n_chars, where there is such a column, follows), widely copied examples stay.

    A mask belongs to an id and a text, compared null-safely: null and repeated ids are masked each,
    repeated rows alike. Null and empty texts stay as they are, an empty table stays empty, and
    all columns of ``docs``, whatever their names, are returned."""
    scanned = scan(docs)
    live = live_spans(scanned).join(scanned.select("row_id", "doc_id", "text_key"), "row_id")
    values = live.select("doc_id", "text_key", F.explode("live").alias("span")).groupBy("doc_id", "text_key").agg(F.collect_set(_value(F.col("span"))).alias("values"))
    # the longest first, so that a value inside another leaves nothing behind
    longest = F.transform(F.sort_array(F.transform("values", lambda v: F.struct(F.length(v).alias("n"), v.alias("v"))), asc=False), lambda x: x["v"])
    masks = materialize(values.select(F.col("doc_id").alias("__gq_id"), F.col("text_key").alias("__gq_key"), longest.alias("__gq_values")), "secret-masks")
    same = F.col("doc_id").eqNullSafe(F.col("__gq_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__gq_key"))
    joined = docs.join(masks, same, "left")
    masked = F.aggregate("__gq_values", F.col("text"), lambda t, v: F.replace(t, v, F.lit("[SECRET]")))
    dirty = F.col("__gq_values").isNotNull()
    cols = {"text": F.when(dirty, masked).otherwise(F.col("text")).alias("text")}
    if "n_chars" in docs.columns:
        cols["n_chars"] = F.when(dirty, F.length(masked).cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return joined.select(*(cols.get(c, F.col(f"`{c}`")) for c in docs.columns))
