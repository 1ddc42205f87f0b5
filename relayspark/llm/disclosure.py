"""Information-theoretic sanitisation of personal data.

Protected entities are the base matches: addresses of mail and machines, card and
telephone numbers. Removing them isn't enough where other terms of the corpus tell
which entity is meant. How strongly a term t reveals an entity c is estimated from
co-occurrence in all rows of the corpus:

    disclosure(t, c) = PMI(t; c) - IC(g(c)) = log2(n(t, c) n(g) / (n(t) n(c)))

g(c) is what may be known of c: its closest generalisation (domain, top level; the
first parts of an address; the first digits) that holds at least GROUP entities of
the corpus, or else its kind. n counts rows (of t and c: with both in one segment, a
sentence, cut after SEGMENT_WORDS words); the size of the corpus cancels. A term
discloses c if it tells EXCESS_BITS or more beyond g(c) and leaves RESIDUAL_BITS or
less of c open: IC(c) - PMI(t; c) = -log2 P(c | t). It is generalised (digits masked,
or cut to its first letters) where that form doesn't disclose c, and removed where it
does. It must share SUPPORT different segments with the entity, so copies of one
sentence prove nothing. Entities themselves are replaced by g(c).

The first pass finds entities and the terms of their segments, which are counted per
entity and term. n(t) is at least the number of rows with t beside any entity, which
most words fail already; a second pass counts what is left in all texts (found by a
bitmap of BITS bits of hashes, counted by term), a third finds the places of the
disclosing terms. No count is sampled, no group is held in one task, and the passes
send counts and matches only, never texts.

Terms are words without outer punctuation, letters A-Z lower-cased, of TERM_CHARS
characters or more; words that overlap a base match aren't terms.

Defined results: a null text is empty and has no spans; equal rows each get the same
result; rows of one id with other texts are kept apart; rows without an id count
like all others; no rows: no result rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from relayspark.llm.common import materialize, slices, split_words, text_rows, word_codes

# Fixed values of the contract: kinds of base matches in their order.
KINDS = ["email", "ip", "card", "phone"]
#: The kind of the spans that the method adds.
TERM = "term"

#: Words of a segment at most; characters of a term at least.
SEGMENT_WORDS, TERM_CHARS = 64, 3
#: Different segments a term and an entity must share, entities of a generalisation.
SUPPORT, GROUP = 3, 5
#: A disclosing term tells so many bits of an entity beyond its generalisation at
#: least, and leaves so many open at most.
EXCESS_BITS, RESIDUAL_BITS = 1.0, 1.0
#: Bits of the candidates' bitmap (2^22).
BITS = 22

# The contract's patterns; the part that every match must begin with is taken whole
# (++), so that long runs without a match take linear time.
_EMAIL = re.compile(r"[A-Za-z0-9._%+-]++(@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)?")
_IP = re.compile(r"[0-9]++((?:\.[0-9]++){3})?")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_OUTER = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def base_matches(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, entity) of the base matches: by kind, then start."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end(), m[0].lower()) for m in _EMAIL.finditer(text) if m[1]]
    for m in _IP.finditer(text):
        if m[1]:
            parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
            if all(len(p) <= 3 and int(p) <= 255 for p in parts):
                out.append(("ip", m.start(), m.end(), ".".join(parts)))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                out.append(("card", m.start(), m.end(), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            if 9 <= len(digits) <= 15:
                out.append(("phone", m.start(), m.end(), digits))
    return out


def generalisations(kind: str, entity: str) -> list[str]:
    """What may be told of an entity, the closest first; the kind is the last."""
    if kind == "email":
        domain = entity.split("@")[1]
        steps = [f"@{domain}", f"@*.{domain.rsplit('.', 1)[1]}"]
    elif kind == "ip":
        parts = entity.split(".")
        steps = [".".join(parts[:n]) + ".*" for n in (3, 2, 1)]
    elif kind == "card":
        steps = [f"{entity[:6]}*", f"{entity[:1]}*"]
    else:
        steps = [f"+{entity[:3]}*", f"+{entity[:2]}*"]
    return [f"{kind} {s}" for s in steps] + [kind]


def term_of(word: str) -> str | None:
    """The word's term, if it has one."""
    core = word.strip(_OUTER)
    # Letters A-Z alone are lower-cased.
    return "".join(c.lower() if c.isascii() else c for c in core) if len(core) >= TERM_CHARS else None


def general_term(term: Column) -> Column:
    """Digits masked, or the first letters of a term without digits."""
    first = F.concat(F.left(term, F.greatest(F.lit(TERM_CHARS), (F.length(term) / 2).cast("int"))), F.lit("*"))
    return F.when(F.rlike(term, F.lit("[0-9]")), F.regexp_replace(term, "[0-9]", "#")).otherwise(first)


def segments(words: list[str]) -> list[int]:
    """Index of the first word of each segment, and the number of words."""
    begins, at = [0] if words else [], 0
    for i, w in enumerate(words[:-1], 1):
        if w[-1] in ".!?" or i - at == SEGMENT_WORDS:
            begins.append(i)
            at = i
    return [*begins, len(words)]


def _segment_hash(words: list[str]) -> int:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63)


def _term_bits(terms: list[str]) -> np.ndarray:
    """Places of the terms in the bitmap: Spark's xxhash64 modulo its size."""
    return np.fromiter((xxhash.xxh64_intdigest(t.encode(), 42) & ((1 << BITS) - 1) for t in terms), np.int64, len(terms))


class _Words:
    """Words of a text with their places, those in base matches marked."""

    def __init__(self, text: str, matches: list[tuple[str, int, int, str]]):
        found = [(m.start(), m.end(), m[0]) for m in _WORD.finditer(text)]
        self.start, self.end, self.words = [list(c) for c in zip(*found)] if found else ([], [], [])
        self.begins = segments(self.words)
        self.taken: set[int] = set()
        for _, start, end, _ in matches:
            self.taken.update(range(bisect_right(self.end, start), bisect_left(self.start, end)))

    def segment_at(self, place: int) -> int:
        """Number of the segment that holds a place of the text."""
        return bisect_right(self.begins, bisect_right(self.start, place) - 1) - 1

    def segment_terms(self, number: int) -> tuple[int, list[str]]:
        begin, end = self.begins[number], self.begins[number + 1]
        terms = {term_of(self.words[i]) for i in range(begin, end) if i not in self.taken}
        return _segment_hash(self.words[begin:end]), sorted(terms - {None})


_MENTION = "row long, id {id}, text_hash long, kind string, start long, end long, entity string, levels array<string>, segment long, terms array<string>"


def _mentions(kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One row for each base match, with its document's number and the terms of
    its segment."""
    strings = pa.list_(pa.string())
    types = [pa.int64(), kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), strings, pa.int64(), strings]
    names = ["row", "id", "text_hash", "kind", "start", "end", "entity", "levels", "segment", "terms"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for whole in batches:
            for batch in slices(whole, "text"):
                rows, held = [], 0
                for key, hashed, text in zip(*(batch.column(c) for c in ("id", "text_hash", "text"))):
                    text = text.as_py()
                    matches = base_matches(text)
                    if not matches:
                        continue
                    row += 1
                    words, known = _Words(text, matches), {}
                    for name, start, end, entity in matches:
                        number = words.segment_at(start)
                        if number not in known:
                            known[number] = words.segment_terms(number)
                        rows.append((row, key.as_py(), hashed.as_py(), name, start, end, entity, generalisations(name, entity), *known[number]))
                        held += 1 + len(known[number][1])
                    if held > 200_000:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _held(batch: pa.RecordBatch, bitmap) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(terms, term, row): each row's distinct terms among those in the bitmap."""
    words, row = split_words(batch.column("text"))
    if len(words) == 0:
        return [], row, row
    distinct, codes = word_codes(words)
    terms = pc.ascii_lower(pc.ascii_trim(distinct, characters=_OUTER)).to_pylist()
    wanted = bitmap.value[_term_bits(terms)]
    place: dict[str, int] = {}
    number = np.array([place.setdefault(t, len(place)) if w else -1 for t, w in zip(terms, wanted.tolist())], np.int64)[codes]
    some = number >= 0
    pairs = np.unique(row[some] * max(len(place), 1) + number[some])
    return list(place), pairs % max(len(place), 1), pairs // max(len(place), 1)


def _counted(bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(term, n): rows that hold a term, summed while there are few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def done() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["term", "n"])

        for whole in batches:
            for batch in slices(whole, "text"):
                terms, term, _ = _held(batch, bitmap)
                total.update(dict(zip(terms, np.bincount(term, minlength=len(terms)).tolist())))
                if len(total) > 500_000:
                    yield done()
                    total.clear()
        yield done()

    return run


def _places(kind: pa.DataType, bitmap) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Occurrences of words whose term is in the bitmap."""
    types = [kind, pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = ["id", "text_hash", "start", "end", "term"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for i in np.unique(_held(batch, bitmap)[2]).tolist():
                    key, hashed, text = (batch.column(c)[i].as_py() for c in ("id", "text_hash", "text"))
                    words = _Words(text, base_matches(text))
                    terms = [(k, t) for k, w in enumerate(words.words) if k not in words.taken and (t := term_of(w))]
                    found = bitmap.value[_term_bits([t for _, t in terms])]
                    rows += [(key, hashed, words.start[k], words.end[k], t) for (k, t), f in zip(terms, found.tolist()) if f]
                    if len(rows) > 65536:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return run


def _bitmap(terms: DataFrame):
    """The terms' bitmap, sent to all machines; None for no terms."""
    bits = [r[0] for r in terms.select(F.pmod(F.xxhash64("term"), F.lit(1 << BITS)).alias("bit")).distinct().toLocalIterator()]
    if not bits:
        return None
    whole = np.zeros(1 << BITS, bool)
    whole[bits] = True
    return terms.sparkSession.sparkContext.broadcast(whole)


def chosen_levels(mentions: DataFrame) -> DataFrame:
    """(entity, n_c, level, n_g): rows that hold an entity, its generalisation and
    the rows that hold any entity of that."""
    of = mentions.select("entity", "row", F.posexplode("levels").alias("step", "level"))
    stats = of.groupBy("level").agg(F.count_distinct("row").alias("n_g"), F.count_distinct("entity").alias("entities"))
    own = mentions.groupBy("entity").agg(F.count_distinct("row").alias("n_c"))
    steps = of.select("entity", "step", "level").distinct().join(stats, "level")
    # Steps grow coarser; the last is the kind, whatever it holds.
    fit = F.when((F.col("entities") >= GROUP) | ~F.contains("level", F.lit(" ")), F.struct("step", "level", "n_g"))
    return steps.groupBy("entity").agg(F.min(fit).alias("at")).join(own, "entity").select("entity", "n_c", "at.level", "at.n_g")


def _disclosure(common: str, of_term: str) -> Column:
    return F.log2(F.col(common) * F.col("n_g") / (F.col(of_term) * F.col("n_c")))


def _discloses(common: str, of_term: str) -> Column:
    left_open = F.log2(F.col(of_term) / F.col(common))
    return (_disclosure(common, of_term) >= EXCESS_BITS) & (left_open <= RESIDUAL_BITS)


def disclosing_terms(rows: DataFrame, mentions: DataFrame, levels: DataFrame) -> DataFrame:
    """(term, bits, replacement) of the terms that disclose an entity."""
    beside = materialize(mentions.select("entity", "row", "segment", F.explode("terms").alias("term")))
    near = beside.groupBy("term").agg(F.count_distinct("row").alias("n_near"))
    pairs = beside.groupBy("entity", "term").agg(F.count_distinct("segment").alias("support"), F.count_distinct("row").alias("n_tc")).where(F.col("support") >= SUPPORT)
    candidates = pairs.join(levels, "entity").join(near, "term").where(_discloses("n_tc", "n_near"))
    candidates = materialize(candidates.withColumn("general", general_term(F.col("term"))))
    bitmap = _bitmap(candidates)
    if bitmap is None:
        return candidates.selectExpr("term", "0D AS bits", "general AS replacement")
    counts = rows.mapInArrow(_counted(bitmap), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t"))
    found = materialize(candidates.join(counts, "term").withColumn("bits", _disclosure("n_tc", "n_t")).where(_discloses("n_tc", "n_t")))
    bitmap.unpersist()

    # A general form is safe if the rows beside entities alone show that it is.
    forms = found.select("entity", "general", "n_c", "n_g").distinct()
    spread = beside.withColumn("general", general_term(F.col("term"))).join(forms.select("general").distinct(), "general", "left_semi")
    with_entity = spread.groupBy("entity", "general").agg(F.count_distinct("row").alias("n_fc"))
    of_form = spread.groupBy("general").agg(F.count_distinct("row").alias("n_f"))
    safe = forms.join(with_entity, ["entity", "general"]).join(of_form, "general").select("entity", "general", (~_discloses("n_fc", "n_f")).alias("safe"))
    each = found.join(safe, ["entity", "general"]).groupBy("term").agg(F.max("bits").alias("bits"), F.max("general").alias("general"), F.min("safe").alias("safe"))
    return materialize(each.select("term", "bits", F.when(F.col("safe"), F.col("general")).otherwise("").alias("replacement")))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_hash, spans) per document; spans: array of kind, start and end in
    code points (end exclusive) and replacement, by kind (terms last), then start;
    the hash (xxhash64) tells texts of one id apart."""
    from pyspark.sql.pandas.types import to_arrow_type

    rows = text_rows(docs, id_col, text_col).select("id", F.xxhash64("text").alias("text_hash"), "text")
    type_ = rows.schema["id"].dataType
    arrow, id_type = to_arrow_type(type_), type_.simpleString()
    some = rows.where(F.rlike("text", F.lit("[0-9@]")))
    base = materialize(some.mapInArrow(_mentions(arrow), _MENTION.format(id=id_type)))
    mentions = base.select("row", "entity", "levels", "segment", "terms").dropDuplicates(["row", "entity", "segment"])
    levels = materialize(chosen_levels(mentions))
    whole = rows.where("text is not null")
    terms = disclosing_terms(whole, mentions, levels)
    bitmap = _bitmap(terms)

    kept = base.select("id", "text_hash", "kind", "start", "end", "entity").distinct()
    own = kept.join(levels.select("entity", F.concat(F.lit("["), "level", F.lit("]")).alias("replacement")), "entity")
    added = own.select("id", "text_hash", "kind", "start", "end", "replacement").limit(0)
    if bitmap is not None:
        places = whole.mapInArrow(_places(arrow, bitmap), f"id {id_type}, text_hash long, start long, end long, term string")
        added = places.join(terms, "term").select("id", "text_hash", F.lit(TERM).alias("kind"), "start", "end", "replacement").distinct()
    spans = own.select(*added.columns).union(added)
    rank = F.array_position(F.array(*map(F.lit, [*KINDS, TERM])), F.col("kind"))
    span = F.struct(rank.alias("rank"), "start", "end", "kind", "replacement")
    listed = spans.groupBy(F.col("id").alias("of_id"), F.col("text_hash").alias("of_text")).agg(F.array_sort(F.collect_list(span)).alias("ranked"))
    joined = rows.select("id", "text_hash").join(listed, F.col("id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_text")), "left")
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint,replacement:string>>")
    ordered = F.transform("ranked", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement")))
    return joined.select(F.col("id").alias(id_col), "text_hash", F.coalesce(ordered, none).alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span replaced; of overlapping spans, by the first."""
    state = "struct<pos:bigint,out:array<string>>"
    first = F.struct(F.lit(0).cast("long").alias("pos"), F.array().cast("array<string>").alias("out")).cast(state)
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["replacement"].alias("replacement"))))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, (acc["pos"] + 1).cast("int"), F.greatest(s["start"] - acc["pos"], F.lit(0)).cast("int"))
        more = F.when(s["start"] >= acc["pos"], F.concat(acc["out"], F.array(F.concat(between, s["replacement"])))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), more.alias("out")).cast(state)

    joined = F.aggregate(ordered, first, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, (acc["pos"] + 1).cast("int"))))
    return F.when(F.size(spans) > 0, joined).otherwise(text)
