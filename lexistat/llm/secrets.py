"""Secret scans judged by corpus-wide ownership (DataFrame functions only).

Patterns find candidate spans; the value of each is hashed. For every hash the distinct owners and the distinct
repositories (an owner's units, by default documents) are counted over all rows. A value that many owners or
repositories hold is a widely copied example; a random-looking value of few holders is live. Long tokens outside
the patterns become spans only if their ownership makes them live.

Only hashes leave the scan, never values. A hash that a third of all rows hold is counted by partial sums, and its
verdict reaches the spans by (hash, salt), so no task gets all its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexistat.llm.frames import col, free_name, settle

# The kinds in their order, the words before a secret and the shapes of keys.
KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api_?key")
VALUE_CLASS = "[A-Za-z0-9+/_.=-]+"
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"

ADDED = "owned"  # the kind of spans that ownership adds
OWNED = "[A-Za-z0-9+/_=-]{20,}"
MIN_VALUE = 6
MIN_DIGITS = 4
MIN_LETTERS = 4
MIN_DISTINCT = 10
MAX_OWNERS = 2
MAX_REPOSITORIES = 20
SALTS = 256


def either_case(pattern: str) -> str:
    """The pattern with a class of both cases for each ASCII letter (case flags differ between engines)."""
    return "".join(f"[{c.upper()}{c}]" if "a" <= c <= "z" else c for c in pattern)


ASSIGN = f"({either_case('|'.join(ASSIGN_WORDS))})[\"']?\\x20*[:=]\\x20*[\"']?({VALUE_CLASS})"
PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, ADDED: OWNED}
NAMES = (*KINDS, ADDED)


def looks_random(value: Column) -> Column:
    """Enough digits, letters and different characters for a generated key."""
    digits = F.length(F.regexp_replace(value, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(value, "[^A-Za-z]", ""))
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (digits >= MIN_DIGITS) & (letters >= MIN_LETTERS) & (kinds >= MIN_DISTINCT)


def matches(text: Column, name: str) -> Column:
    """Matches of one kind, in order: the length of the text before each since the last one, its own length, the
    hash of its value, and whether the value passes. Texts without a match cost one search."""
    pattern = PATTERNS[name]
    pairs = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit")
    )

    def described(pair: Column, place: Column) -> Column:
        value = F.regexp_extract(pair["hit"], pattern, 2) if name == "assign" else pair["hit"]
        passes = F.length(value) >= MIN_VALUE
        if name == ADDED:
            passes = looks_random(value)
        return F.struct(
            F.lit(NAMES.index(name)).alias("kind"), place.alias("place"), F.length(pair["gap"]).alias("gap"),
            F.length(pair["hit"]).alias("length"), F.unhex(F.md5(value)).alias("hash"),
            looks_random(value).alias("random"), passes.alias("passes"),
        )

    return F.when(text.rlike(pattern), F.transform(F.filter(pairs, lambda p: p["hit"].isNotNull()), described))


def found_spans(df: DataFrame, row: str, found: str, keys: list[str]) -> DataFrame:
    """One row per candidate span: row, keys, kind, start, end (code points, end exclusive), hash, random."""
    one = df.select(row, *keys, F.explode(found).alias("s")).select(row, *keys, "s.*").repartition(row)
    so_far = Window.partitionBy(row, "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    placed = one.withColumn("end", F.sum(F.col("gap") + F.col("length")).over(so_far)).where("passes")
    placed = placed.withColumn("start", F.col("end") - F.col("length"))
    by_start = Window.partitionBy(row).orderBy("start", "kind")
    base = F.col("kind") < len(KINDS)
    before = F.max(F.when(base, F.col("end"))).over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rowsBetween(1, Window.unboundedFollowing))
    clear = (F.coalesce(before, F.lit(0)) <= F.col("start")) & F.coalesce(after >= F.col("end"), F.lit(True))
    return placed.withColumn("clear", clear).where(base | F.col("clear")).select(
        row, *keys, "kind", "start", "end", "hash", "random"
    )


def ownership(spans: DataFrame, owner: str, repository: str) -> DataFrame:
    """Distinct owners and distinct (owner, repository) pairs of each hash; a null is a holder of its own."""
    held = spans.groupBy("hash", owner, repository).agg(F.lit(1).alias("one"))
    by_owner = held.groupBy("hash", owner).agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repositories"))


def with_ownership(spans: DataFrame, owners: DataFrame, row: str) -> DataFrame:
    """Each span with the counts of its hash. The counts are laid out by (hash, salt) first: at most SALTS rows of
    a hash meet in the first join, and the spans of a hot hash are dealt to SALTS keys in the second."""
    salted = spans.withColumn("salt", F.pmod(F.xxhash64(row), F.lit(SALTS)))
    keys = salted.groupBy("hash", "salt").agg(F.lit(1).alias("one")).drop("one").join(owners, "hash")
    return salted.join(keys, ["hash", "salt"]).drop("salt")


def scan_secrets(
    docs: DataFrame, text: str = "text", owner: str = "source", repository: str = "doc_id", keep_text: bool = False
) -> tuple[DataFrame, str]:
    """The rows of docs (without the text unless keep_text) with an array of their secrets, and its column name.

    Each secret has kind, start, end (code points, end exclusive), hash (md5 of the value), n_owners,
    n_repositories and verdict: `example` (more than MAX_OWNERS owners or MAX_REPOSITORIES repositories), `live`
    (few holders and random-looking) or `unclear`. They are sorted by start, then kind as listed in NAMES.

    Null and empty texts have an empty array; any length is scanned whole. Repeated rows are rows of their own,
    but count as one repository; a null owner or repository is a holder of its own. Ties between kinds at one
    start follow NAMES. An empty table gives an empty one. Other columns are kept, whatever their names.
    """
    row, found, out = (free_name(docs, n) for n in ("_row", "_found", "secrets"))
    t = F.coalesce(col(text), F.lit(""))
    every = [F.coalesce(matches(t, n), F.array()) for n in NAMES]
    kept = [c for c in docs.columns if keep_text or c != text]
    # Written once: the texts are scanned a single time, and the row numbers are fixed from here on.
    read = settle(docs.select(*[col(c) for c in kept], F.concat(*every).alias(found),
                              F.monotonically_increasing_id().alias(row)))
    own, repo = "_owner", "_repository"
    hit = read.where(F.size(found) > 0)
    keyed = hit.select(F.col(row).alias("_at"), col(owner).alias(own), col(repository).alias(repo),
                       F.col(found).alias("_list"))
    spans = settle(found_spans(keyed, "_at", "_list", [own, repo]))
    copied = (F.col("n_owners") > MAX_OWNERS) | (F.col("n_repositories") > MAX_REPOSITORIES)
    judged = with_ownership(spans, ownership(spans, own, repo), "_at").withColumn(
        "verdict", F.when(copied, "example").when(F.col("random"), "live").otherwise("unclear")
    ).where((F.col("kind") < len(KINDS)) | (F.col("verdict") == "live"))
    names = F.array(*[F.lit(n) for n in NAMES])
    listed = judged.groupBy("_at").agg(F.sort_array(F.collect_list(F.struct(
        "start", "kind", "end", F.lower(F.hex("hash")).alias("hash"), "n_owners", "n_repositories", "verdict",
    ))).alias("_list")).select("_at", F.transform("_list", lambda s: F.struct(
        F.get(names, s["kind"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["hash"].alias("hash"),
        s["n_owners"].alias("n_owners"), s["n_repositories"].alias("n_repositories"), s["verdict"].alias("verdict"),
    )).alias(out))
    columns = [col(c) for c in kept]
    none = F.array().cast(listed.schema[out].dataType)
    with_hits = hit.join(listed, hit[row] == listed["_at"], "left").select(
        *[hit["`" + c.replace("`", "``") + "`"] for c in kept], F.coalesce(listed[out], none).alias(out)
    )
    return with_hits.unionAll(read.where(F.size(found) == 0).select(*columns, none.alias(out))), out


def joined_spans(secrets: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans, and counts of added, live and example spans."""
    read, secrets = scan_secrets(docs)
    s = col(secrets)

    def count(field: str, value: str) -> Column:
        return F.size(F.filter(s, lambda x: x[field] == value)).cast("bigint")

    return read.select(
        "doc_id",
        *[count("kind", n).alias(f"n_{n}") for n in KINDS],
        F.sha2(joined_spans(F.filter(s, lambda x: x["kind"] != ADDED)).cast("binary"), 256).alias("base_sha256"),
        joined_spans(s).alias("spans"),
        count("kind", ADDED).alias("n_added"),
        count("verdict", "live").alias("n_live"),
        count("verdict", "example").alias("n_example"),
    )
