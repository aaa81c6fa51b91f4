"""Personal data: base patterns with checks, and information-theoretic sanitisation.

Protected entities are the values the base patterns find (e-mail, IP, card, phone). For
every word the corpus tells how strongly it reveals an entity: with n(t), n(v), n(t, v) the numbers of
different documents that hold the word (outside all base spans), the entity, and both of them anywhere,
the disclosure is P(v | t) = n(t, v) / n(t), worth log2(P(v | t) / P(v)) bits. A word is a
span of kind ``term``, in all documents, if for some entity the disclosure reaches ``min_share`` in ``min_docs``
documents and more, and either each of them yields ``min_bits``, or all of them together ``min_evidence``
bits: an entity that many documents hold is worth few bits a document, and is protected by
the words that go with it in many. Terms are generalised or removed like the base spans.

DataFrame functions only. All counts cover all documents, equal texts counted once: their words and entities
are made distinct by text first, and every count is a partial aggregate by word, by entity or by both. Positions
are running sums by blocks, so a text with very many matches takes time in proportion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import lower_az, spare, stored

KINDS = ("email", "ip", "card", "phone", "term")
# Fixed patterns, in forms that Java's regex engine matches without recursion.
# (?:\G|(?<!x)) keeps the search linear on long runs: a match begins where a run of x
# begins or where the match before ended, never later inside a run. The repeated groups
# of the e-mail and card rules become one character class, after their separators that
# join nothing are replaced (same length; "_" may stand in a local part only).
LOOSE_DOT = r"\.(?![A-Za-z0-9-])|(?<![A-Za-z0-9-])\."
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]++"
IP = r"(?:\G|(?<![0-9]))[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)"
LOOSE_GAP = r"[\x20-](?![0-9])|(?<![0-9])[\x20-]"
CARD = r"[0-9][0-9\x20-]++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = r"0-9A-Za-z\x{80}-\x{10FFFF}"  # characters of a term
SPLIT_TERMS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPREAD = 8
BROADCAST_TEXTS = 2_000_000  # hashes of 8 bytes
BLOCK = 256  # of the running sums inside a row

SPANS = "array<struct<start:bigint,rank:int,finish:bigint,value:string>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _running(values: Column, zero: Column, op) -> Column:
    """Running ``op`` (associative) along an array, each element included: totals of blocks of ``BLOCK`` first, then inside the blocks,
    so no long array is copied for each of its elements."""
    def inside(some: Column, first: Column, with_element: bool) -> Column:
        start = F.struct(first.alias("at"), F.filter(F.array(zero), lambda x: F.lit(False)).alias("out"))

        def step(acc, x):
            new = op(acc["at"], x)
            return F.struct(new.alias("at"), F.concat(acc["out"], F.array(new if with_element else acc["at"])).alias("out"))

        return F.aggregate(some, start, step, lambda acc: acc["out"])

    def blocks_of(v: Column) -> Column:
        firsts = F.when(F.size(v) > 0, F.sequence(F.lit(0), F.size(v) - 1, F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        return F.transform(firsts, lambda at: F.transform(F.sequence(at, F.least(at + BLOCK, F.size(v)) - 1), lambda i: F.get(v, i)))

    def scan(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, op))
        return _let(inside(totals, zero, False), lambda before: F.flatten(F.transform(blocks, lambda b, i: inside(b, F.get(before, i), True))))

    return _let(values, lambda v: _let(blocks_of(v), scan))


def _matches(text: Column, pattern: Column, rank: int) -> Column:
    """Structs ``start``, ``rank``, ``finish``, ``value`` of all leftmost matches, in code points."""
    def place(hits: Column) -> Column:
        # The last gap has no match after it.
        lengths = F.transform(F.filter(F.zip_with(F.split(text, pattern), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h"))),
                                       lambda x: x["h"].isNotNull()), lambda x: (F.length(x["g"]) + F.length(x["h"])).cast("bigint"))
        return _let(_running(lengths, F.lit(0).cast("bigint"), lambda x, y: x + y), lambda ends: F.transform(hits, lambda h, i: F.struct(
            (F.get(ends, i) - F.length(h)).alias("start"), F.lit(rank).alias("rank"), F.get(ends, i).alias("finish"), h.alias("value"))))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), place)


def _apart(found: Column, base: Column) -> Column:
    """The spans of ``found`` (sorted, apart from one another) that no span of ``base`` overlaps. Both are sorted into one
    array; what matters to a span is how far the base spans before it reach, and where the next one begins."""
    both = F.array_sort(F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["finish"].alias("finish"), s.alias("span"))),
                                 F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["finish"].alias("finish"), s.alias("span")))))
    never, far = F.lit(-1).cast("bigint"), F.lit(1 << 62).cast("bigint")

    def keep(all_: Column) -> Column:
        reach = _running(F.transform(all_, lambda x: F.when(x["own"] == 0, x["finish"]).otherwise(never)), never, lambda a, b: F.greatest(a, b))
        begins = F.reverse(_running(F.reverse(F.transform(all_, lambda x: F.when(x["own"] == 0, x["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        return _let(reach, lambda r: _let(begins, lambda n: F.transform(F.filter(all_, lambda x, i: (x["own"] == 1) & (F.get(r, i) <= x["start"])
                                                                                & (F.get(n, i) >= x["finish"])), lambda x: x["span"])))

    return F.when(F.size(base) == 0, found).otherwise(_let(both, keep))


def _words_in(found: Column, words: Column) -> Column:
    """The spans of ``found`` whose value is one of ``words``, in their order. Sorted together, a value's word comes right before it."""
    both = F.array_sort(F.concat(F.transform(words, lambda w: F.struct(w.alias("value"), F.lit(-1).cast("bigint").alias("start"), F.lit(None).cast(SPANS[6:-1]).alias("span"))),
                                 F.transform(found, lambda s: F.struct(s["value"].alias("value"), s["start"].alias("start"), s.alias("span")))))

    def keep(all_: Column) -> Column:
        last = _running(F.transform(all_, lambda x: F.when(x["start"] < 0, x["value"]).otherwise("")), F.lit(""), lambda a, b: F.greatest(a, b))
        return _let(last, lambda w: F.array_sort(F.transform(F.filter(all_, lambda x, i: (x["start"] >= 0) & (F.get(w, i) == x["value"])), lambda x: x["span"])))

    return _let(both, keep)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    d = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(
        F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2)))
    return F.aggregate(F.filter(d, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10 == 0


def _small_part(part: Column) -> Column:
    short = F.regexp_replace(part, "^0+(?=.)", "")
    return (F.length(short) < 4) & (F.substring(F.lpad(short, 3, "0"), 1, 3) <= "255")


def base_spans(text: Column) -> Column:
    """All base spans of a text, sorted by start, then kind."""
    none = F.expr(f"CAST(array() AS {SPANS})")
    email = F.when(F.contains(text, F.lit("@")), _matches(F.regexp_replace(text, LOOSE_DOT, "_"), F.lit(EMAIL), 0)).otherwise(none)
    ip = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_matches(text, F.lit(IP), 1),
                lambda s: F.forall(F.split(s["value"], r"\."), _small_part))).otherwise(none)
    card = F.when(text.rlike(r"[0-9]([\x20-]?[0-9]){11}"), F.filter(_matches(F.regexp_replace(text, LOOSE_GAP, "_"), F.lit(CARD), 2), lambda s: F.length(_digits(s["value"])).between(12, 19)
                                                                    & _luhn(_digits(s["value"])))).otherwise(none)
    phone = F.when(F.contains(text, F.lit("+")), F.filter(_matches(text, F.lit(PHONE), 3),
                   lambda s: F.length(_digits(s["value"])).between(9, 15))).otherwise(none)
    return F.array_sort(F.concat(email, ip, card, phone))


WORDS = f"[{WORD}]++"


def free_words(text: Column, base: Column) -> Column:
    """Different words of a text, A-Z in lower case, that stand outside its base spans somewhere."""
    low = lower_az(text)
    plain = F.filter(F.split(low, SPLIT_TERMS), lambda w: w != "")
    return F.array_distinct(F.when(F.size(base) == 0, plain).otherwise(
        F.transform(_apart(_matches(low, F.lit(WORDS), 4), base), lambda s: s["value"])))


def revealing_terms(facts: DataFrame, min_docs: int, min_share: float, min_bits: float, min_evidence: float) -> DataFrame:
    """``term``, ``bits``: words that reveal an entity. ``facts``, one row per different text: ``th`` (its hash), ``entities`` and
    ``terms`` (arrays without repeats). A word's bits are those of the entity it reveals most strongly."""
    held = facts.where(F.size("entities") > 0)
    n_v = held.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count("*").alias("n_v")).where(F.col("n_v") >= min_docs)
    n_v = stored(n_v.select("e", "n_v", F.monotonically_increasing_id().alias("v")), "pii-entities")  # written once, so the numbers stay
    often = held.select("th", F.explode("entities").alias("e")).join(n_v.select("e", "v"), "e").groupBy("th").agg(F.collect_list("v").alias("vs"))
    both = held.select("th", "terms").join(often, "th").select(F.explode("vs").alias("v"), "terms").select("v", F.explode("terms").alias("term"))
    n_tv = both.groupBy("v", "term").agg(F.count("*").alias("n_tv")).where(F.col("n_tv") >= min_docs)
    n_t = facts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t") >= min_docs)
    total = facts.count()
    bits = F.log2(F.col("n_tv") * F.lit(float(total)) / (F.col("n_t") * F.col("n_v")))
    return (n_tv.join(n_t, "term").where(F.col("n_tv") >= F.lit(min_share) * F.col("n_t")).join(n_v.select("v", "n_v"), "v")
            .select("term", "n_tv", bits.alias("bits")).where((F.col("bits") >= min_bits) | (F.col("n_tv") * F.col("bits") >= min_evidence))
            .groupBy("term").agg(F.max("bits").alias("bits")))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 3,
               min_share: float = 0.9, min_bits: float = 5.0, min_evidence: float = 40.0) -> DataFrame:
    """Per row: id, ``base`` and ``spans`` (base and term spans; sorted structs ``start``,
    ``rank`` of the kind in ``KINDS``, ``finish``, ``value``), and ``th`` (hash of the text).

    Null text counts as empty and has no spans; repeated rows count once in the
    statistics and get the same spans; words inside a base span are no terms. An empty
    table gives an empty result; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.select("id", "text", F.xxhash64("text").alias("th"))
    entity = lambda s: F.concat_ws(":", s["rank"].cast("string"), F.lower(s["value"]))
    # Texts are made distinct before they are scanned: copies cost a hash each, and lists of words are never shuffled.
    texts = rows.select("th", "text").dropDuplicates(["th"]).withColumn("base", base_spans(F.col("text")))
    facts = stored(texts.select("th", F.array_distinct(F.transform("base", entity)).alias("entities"), free_words(F.col("text"), F.col("base")).alias("terms")), "pii-facts")
    base = rows.select("id", "th", base_spans(F.col("text")).alias("base"))
    terms = stored(revealing_terms(facts, min_docs, min_share, min_bits, min_evidence), "pii-terms")
    if terms.isEmpty():
        return base.select(F.col("id").alias(id_col), "th", "base", F.col("base").alias("spans"))
    hit = stored(facts.select("th", F.explode("terms").alias("term")).join(terms.select("term"), "term", "left_semi")
                 .groupBy("th").agg(F.collect_list("term").alias("terms")), "pii-hits")
    some = rows
    if hit.count() <= BROADCAST_TEXTS:  # the texts without a term are left out before the others are shuffled
        some = rows.join(F.broadcast(hit.select("th")), "th", "left_semi")
    # A text's copies are spread over ``SPREAD`` keys: they do not meet in one task.
    salt = F.pmod(F.xxhash64("id"), F.lit(SPREAD)).cast("int")
    hit = hit.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    low = lower_az(F.col("text"))
    texts = some.withColumn("salt", salt).join(hit, ["th", "salt"])
    placed = texts.select("id", "th", _words_in(_matches(low, F.lit(WORDS), 4), F.col("terms")).alias("found"))
    placed = placed.groupBy(F.col("id").alias("_id"), F.col("th").alias("_th")).agg(F.first("found").alias("found"))
    both = base.join(placed, F.col("id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left")
    free = F.when(F.col("found").isNull(), F.expr(f"CAST(array() AS {SPANS})")).otherwise(_apart(F.col("found"), F.col("base")))
    return both.select(F.col("id").alias(id_col), "th", "base", F.array_sort(F.concat("base", free)).alias("spans"))


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["finish"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Per row: id, counts by kind, digest of the base spans, and all spans as text. Null and empty texts have no
    spans; repeated rows stay repeated; the other cases are those of ``find_spans``."""
    found = find_spans(docs, id_col, text_col, **kw)

    def count(rank: int) -> Column:
        return F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long").alias(f"n_{KINDS[rank]}")

    counts = [count(rank) for rank in range(4)]
    return found.select(id_col, *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: bool = False, **kw) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, or removed; where spans
    overlap, the later one is part of the earlier. Null text stays null, empty text empty; repeated rows stay
    repeated and are changed alike; an empty table gives an empty result. Other columns are kept, whatever their names."""
    own = spare("_spans", docs)
    found = (find_spans(docs, id_col, text_col, **kw).where("size(spans) > 0")
             .select(F.struct(F.col(id_col).alias("id"), F.col("th").alias("th")).alias(spare("_row", docs)), F.col("spans").alias(own)))
    row = found.columns[0]
    found = found.dropDuplicates([row])
    both = docs.join(found, F.struct(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("th")).eqNullSafe(F.col(row)), "left")
    text = F.col(f"`{text_col}`").cast("string")
    mark = (lambda s: F.lit("")) if remove else (lambda s: F.concat(F.lit("["), F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1), F.lit("]")))
    none = F.array().cast("array<string>")

    def between(chars: Column, start: Column, end: Column) -> Column:
        return F.when(end > start, F.transform(F.sequence(start, end - 1), lambda i: F.get(chars, i.cast("int")))).otherwise(none)

    def cut(spans: Column, chars: Column) -> Column:
        reach = _running(F.transform(spans, lambda s: s["finish"]), F.lit(0).cast("bigint"), lambda a, b: F.greatest(a, b))
        size = F.size(chars).cast("bigint")

        def parts(ends: Column) -> Column:
            # The text from the end of all spans before up to this one, and its mark unless it begins inside one of them.
            before = lambda i: F.coalesce(F.get(ends, i - 1), F.lit(0).cast("bigint"))
            pieces = F.flatten(F.transform(spans, lambda s, i: F.concat(between(chars, before(i), s["start"]), F.when(s["start"] >= before(i), F.array(mark(s))).otherwise(none))))
            return F.concat(pieces, between(chars, F.element_at(ends, -1), size))

        return F.array_join(_let(reach, parts), "")

    done = _let(F.col(own), lambda spans: _let(F.regexp_extract_all(text, F.lit(r"(?s)."), F.lit(0)), lambda chars: cut(spans, chars)))
    return (both.withColumn(text_col, F.when(F.col(own).isNotNull(), done).otherwise(F.col(f"`{text_col}`")))
            .select(*[F.col(f"`{c}`") for c in docs.columns]))
