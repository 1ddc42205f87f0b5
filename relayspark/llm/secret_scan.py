"""Secret scans: base patterns, and credentials whose parts stand apart.

Base spans are the leftmost non-overlapping matches of each kind's pattern.
Beside them, weak candidates (access identifiers that are short or of other
prefixes, bare 40-character secrets, service endpoints) are linked by an interval
join: each part opens the interval of its scope around it. An access identifier and
a secret that lie in each other's scope are linked into a credential; candidates
that are part of none aren't reported. An endpoint is reported if it lies in the
scope of a linked part. Two sorted sweeps over a text's parts find the nearest part
of each other sort on either side, then the nearest linked one; work is linear in
the number of parts.

Built-in functions only. Positions come from splitting a text at the matches and
adding up the lengths of pieces and matches, in rows, so a text of any number of
matches takes linear work.

Defined results: null and empty texts have no spans; equal rows (same id, same
text) each get the same result; rows of one id with other texts are kept apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from relayspark.llm.common import text_rows

# Fixed values of the contract: kind, pattern, least length (of group 2 for
# assign, else of the match).
BASE_KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6),
    ("access", r"AKIA[A-Z0-9]+", 20),
    ("hex", r"[0-9a-f]+", 24),
]

# Cheap tests that every text with a span of the kind passes, and patterns
# that find the same spans faster (short runs are never spans of these kinds).
_SCAN = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}

#: Parts that count only together: kind, pattern, sort of part.
WEAK_KINDS = [
    ("weak_access", r"(?<![A-Za-z0-9])(?:AKIA[A-Z0-9]{8,15}|(?:ASIA|AROA|AIDA|AGPA)[A-Z0-9]{8,})(?![A-Za-z0-9])", "access"),
    ("weak_secret", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/]*[0-9])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=_-])", "secret"),
    ("endpoint", r"https?://[A-Za-z0-9.-]+(?::[0-9]+)?", "endpoint"),
]

#: Part that a base kind plays in a linked credential.
BASE_PART = {"assign": "secret", "access": "access", "hex": "secret"}

#: Code points between two parts of one credential at most.
SCOPE = 300

KIND_ORDER = [k for k, *_ in BASE_KINDS] + [k for k, *_ in WEAK_KINDS]


def _pieces(kind: str, pattern: str) -> Column:
    """Matches of a pattern with the piece of text before each."""
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    before = F.slice(F.split("text", pattern, -1), F.lit(1), F.size(found))
    each = F.transform(
        F.arrays_zip(before.alias("before"), found.alias("found")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["before"]).alias("skip"), x["found"].alias("found")),
    )
    return F.when(F.rlike("text", F.lit(pattern)), each)


def found_parts(texts: DataFrame) -> DataFrame:
    """(id, text_hash, kind, start, end, found) of all matches that are long
    enough, in equal texts of one id once."""
    least = {k: n for k, _, n in BASE_KINDS}
    patterns = [(k, _SCAN.get(k, p)) for k, p, _ in BASE_KINDS] + [(k, p) for k, p, *_ in WEAK_KINDS]
    arrays = [F.coalesce(_pieces(k, p), F.array().cast("array<struct<kind:string,skip:int,found:string>>")) for k, p in patterns]
    listed = texts.where(F.rlike("text", F.lit("|".join(p for _, p in patterns)))).select(
        "id", F.xxhash64("text").alias("text_hash"), F.explode(F.array(*arrays)).alias("of_kind")
    )
    each = listed.select("id", "text_hash", F.posexplode("of_kind").alias("place", "m")).select("id", "text_hash", "place", "m.*")
    each = each.dropDuplicates(["id", "text_hash", "kind", "place"])
    along = Window.partitionBy("id", "text_hash", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    value = F.regexp_extract("found", BASE_KINDS[0][1], 2)
    size = F.when(F.col("kind") == "assign", F.length(value)).otherwise(F.length("found"))
    long_enough = F.lit(True)
    for k, n in least.items():
        long_enough = long_enough & ((F.col("kind") != k) | (size >= n))
    end = F.sum(F.col("skip") + F.length("found")).over(along)
    return each.withColumn("end", end).withColumn("start", F.col("end") - F.length("found")).where(long_enough).select("id", "text_hash", "kind", "start", "end", "found")


def linked_parts(parts: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, weak parts of credentials and the endpoints beside these."""
    sort = F.lit(None).cast("string")
    for kind, part in [*BASE_PART.items(), *((k, p) for k, _, p in WEAK_KINDS)]:
        sort = F.when(F.col("kind") == kind, F.lit(part)).otherwise(sort)
    sweep = Window.partitionBy("id", "text_hash").orderBy("start", "end", "kind")
    before, after = sweep.rowsBetween(Window.unboundedPreceding, -1), sweep.rowsBetween(1, Window.unboundedFollowing)

    def within(of: Column) -> Column:
        """The nearest such part on either side is in scope."""
        gap_before = F.col("start") - F.max(F.when(of, F.col("end"))).over(before)
        gap_after = F.min(F.when(of, F.col("start"))).over(after) - F.col("end")
        return F.coalesce(F.least(gap_before, gap_after) <= scope, F.lit(False))

    parts = parts.withColumn("sort", sort)
    beside = {"access": within(F.col("sort") == "secret"), "secret": within(F.col("sort") == "access")}
    linked = F.lit(False)
    for part, near in beside.items():
        linked = F.when(F.col("sort") == part, near).otherwise(linked)
    parts = parts.withColumn("linked", linked)
    served = (F.col("sort") == "endpoint") & within(F.col("linked"))
    kept = parts.withColumn("served", served).where(F.col("kind").isin(list(BASE_PART)) | F.col("linked") | F.col("served"))
    return kept.select("id", "text_hash", "kind", "start", "end", "found")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """(id, text_hash, spans) per document; spans: array of kind, start and end
    in code points (end exclusive), by start, then kind, then end; the hash
    (xxhash64) tells texts of one id apart."""
    texts = text_rows(docs, id_col, text_col)
    rank = F.array_position(F.array(*map(F.lit, KIND_ORDER)), F.col("kind"))
    span = F.struct(F.col("start").cast("long").alias("start"), rank.alias("rank"), F.col("end").cast("long").alias("end"), F.col("kind"))
    spans = (
        linked_parts(found_parts(texts), scope)
        .groupBy(F.col("id").alias("of_id"), "text_hash")
        .agg(F.array_sort(F.collect_list(span)).alias("ranked"))
    )
    keyed = texts.select("id", F.xxhash64("text").alias("hash"))
    joined = keyed.join(spans, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("hash") == F.col("text_hash")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    ordered = F.transform("ranked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return joined.select(F.col("id").alias(id_col), F.col("hash").alias("text_hash"), F.coalesce(ordered, none).alias("spans"))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span replaced; overlapping spans become one mark."""
    state = "struct<pos:bigint,out:array<string>>"
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out")).cast(state)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["pos"]
        between = F.substr(text, (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        more = F.when(fresh, F.concat(acc["out"], F.array(F.concat(between, F.lit(mark))))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), more.alias("out")).cast(state)

    joined = F.aggregate(spans, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["pos"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)


def base_digest(spans: Column, kinds: list[str] | None = None) -> Column:
    """kind:start:end of the spans (of some kinds), comma-joined."""
    chosen = F.filter(spans, lambda s: s["kind"].isin(kinds)) if kinds else spans
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
