"""Benchmark decontamination: windows of normalised benchmark words in a broadcast
hash set, looked up for the windows of every document.

Only DataFrame functions run here. A document stays one row: the positions whose
first ``ANCHOR`` words hash into the (small) set of window beginnings are picked
inside the row, only their windows are exploded and compared word for word with the
broadcast windows, and one small aggregate puts the hits of a document together. No
text is shuffled then. A benchmark beyond the documented bound is not broadcast: the hashes of all beginnings of
windows in the documents are joined with its own by a shuffle, and only texts with a common one go on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import lower_az, spare, stored

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # what is no word, after lower-casing A-Z
SEPARATORS_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
ANCHOR = 5
BROADCAST_WINDOWS = 100_000  # beyond: shuffled join
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """Lower-case words of a text; null has none."""
    return F.array_remove(F.split(lower_az(F.coalesce(text.cast("string"), F.lit(""))), SEPARATORS), "")


def benchmark_windows(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """Distinct windows: ``w`` (words joined by a space), ``len``, ``items`` (ids, sorted;
    null ids name nothing) and ``anchor`` (hash of the first words). An item with fewer
    words than a window is one window; without words it has none."""
    words = benchmark.select(F.col(item_col).alias("item"), words_of(F.col(text_col)).alias("words"))
    each = words.where("size(words) > 0").select(
        "item", F.expr(f"""explode(CASE WHEN size(words) >= {window}
            THEN transform(sequence(1, size(words) - {window - 1}), i -> slice(words, i, {window}))
            ELSE array(words) END)""").alias("s"))
    return (each.groupBy("s").agg(F.sort_array(F.collect_set("item")).alias("items"))
            .select(F.array_join("s", " ").alias("w"), F.size("s").alias("len"), "items", F.col("s").alias("head")))


def _anchor_sql(n: int) -> str:
    return "xxhash64(" + ", ".join(f"get(words, i + {j})" for j in range(n)) + ")"


def _with_spots(rows: DataFrame, heads: dict[int, DataFrame]) -> DataFrame:
    """``rows`` with ``spots`` (structs ``pos``, ``len``): where a text has the hashed beginning of some window. What is shuffled are
    hashes and places of all beginnings, 8 bytes and two numbers each, and then the texts that have any; equal texts
    go by one hash."""
    each = ", ".join(f"""CASE WHEN size(words) >= {n} THEN transform(sequence(0, size(words) - {n}),
        i -> named_struct('pos', i, 'len', {n}, 'key', {_anchor_sql(min(n, ANCHOR))})) ELSE array() END""" for n in heads)
    none = "CAST(array() AS array<struct<pos:int,len:int,key:bigint>>)"
    begins = rows.select("text_hash", F.expr(f"inline(concat({none}, {each}))"))
    known = None
    for n, keys in heads.items():
        part = keys.select(F.lit(n).alias("len"), "key")
        known = part if known is None else known.unionByName(part)
    spots = stored(begins.join(known, ["len", "key"]).groupBy("text_hash").agg(F.collect_set(F.struct("pos", "len")).alias("spots")), "spots")
    return rows.join(spots, "text_hash", "left").withColumn("spots", F.coalesce("spots", F.expr("CAST(array() AS array<struct<pos:int,len:int>>)")))


def find_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
              max_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document row: ``id``, ``text_hash``, ``n_words``, ``hits`` (sorted structs ``pos``,
    ``len`` of the occurring windows) and ``items`` (ids with an occurring window).

    Null and empty texts have no words and no hits; repeated rows are judged one by
    one; an empty benchmark hits nothing; other columns are not read."""
    grams = benchmark_windows(benchmark, item_col, item_text_col, window)
    size = grams.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("w") + 16 + 8 * F.size("items")), F.lit(0)).alias("bytes"),
                     F.sort_array(F.collect_set("len")).alias("lens")).first()
    small = size["n"] <= max_broadcast and size["bytes"] <= BROADCAST_BYTES
    # The words are computed once per row: the non-deterministic row number keeps the
    # projection that makes them from being merged into its users.
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
                       words_of(F.col(text_col)).alias("words"), F.monotonically_increasing_id().alias("row"))
    heads = {n: grams.where(F.col("len") == n).select(F.xxhash64(*[F.try_element_at("head", F.lit(j + 1)) for j in range(min(n, ANCHOR))]).alias("key")).distinct()
             for n in size["lens"]}  # at most `window` lengths; only short items add lengths below it
    window_at = "array_join(transform(sequence({at}, {at} + {n} - 1), k -> words[k]), ' ')"
    picks = []
    if small:
        for n, keys in heads.items():
            known = ", ".join(f"{k}L" if k > -2**63 else "(-9223372036854775807L - 1L)" for (k,) in keys.collect())
            picks.append(f"""CASE WHEN size(words) >= {n}
                THEN transform(filter(sequence(0, size(words) - {n}), i -> {_anchor_sql(min(n, ANCHOR))} IN ({known})),
                               i -> named_struct('pos', i, 'len', {n}, 'w', {window_at.format(at="i", n=n)})) ELSE array() END""")
    elif heads:
        rows = _with_spots(rows, heads)
        picks.append(f"transform(spots, s -> named_struct('pos', s.pos, 'len', s.len, 'w', {window_at.format(at='s.pos', n='s.len')}))")
    none = "CAST(array() AS array<struct<pos:int,len:int,w:string>>)"
    picked = rows.select("row", "id", "text_hash", F.size("words").cast("long").alias("n_words"),
                         F.expr(f"concat({', '.join([none, *picks])})").alias("cand"))
    each = picked.select("row", "id", "text_hash", "n_words", F.explode_outer("cand").alias("c")) \
        .select("row", "id", "text_hash", "n_words", "c.pos", "c.len", F.col("c.w").alias("w"))
    table = grams.select("w", "items")
    found = each.join(F.broadcast(table) if small else table, "w", "left")
    hit = F.col("items").isNotNull()
    return (found.groupBy("row").agg(
        F.first("id").alias("id"), F.first("text_hash").alias("text_hash"), F.first("n_words").alias("n_words"),
        F.sort_array(F.collect_list(F.when(hit, F.struct("pos", "len")))).alias("hits"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")).drop("row"))


def covered(hits: str = "hits") -> Column:
    """Number of words in any hit window (sorted by position)."""
    return F.expr(f"""aggregate({hits}, named_struct('n', 0L, 'upto', 0L),
        (a, h) -> named_struct('n', a.n + greatest(0L, h.pos + h.len - greatest(a.upto, CAST(h.pos AS bigint))),
                               'upto', greatest(a.upto, CAST(h.pos + h.len AS bigint))), a -> a.n)""")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                  share: int = 20, max_broadcast: int = BROADCAST_WINDOWS) -> DataFrame:
    """Per document: id, ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``,
    ``contaminated`` (some hit, and at least one word in ``share`` is hit), and
    ``text_hash`` to find the row again."""
    found = find_hits(docs, benchmark, id_col, text_col, item_col, item_text_col, window, max_broadcast)
    out = found.select(F.col("id").alias(id_col), "text_hash", "n_words", covered().alias("n_hit"),
                       F.size("items").cast("long").alias("n_items"),
                       F.sha2(F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      **kw) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all their columns, whatever their names.

    Null and empty texts stay; rows are judged by their text, so repeated rows stay or go together, also with a null id; an empty
    table or benchmark drops nothing. The short list of what goes is written first: its size is then
    known, and where it is small it is sent to the rows instead of moving them."""
    gone = spare("_gone", docs)
    bad = contamination(docs, benchmark, id_col, text_col, **kw).where("contaminated").select(F.col("text_hash").alias(gone)).distinct()
    bad = stored(bad, "contaminated")
    return docs.join(bad, F.xxhash64(F.col(f"`{text_col}`")) == F.col(gone), "left_anti")


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 **kw) -> DataFrame:
    """``docs`` with the hit words cut out of ``text_col`` (what lies between words stays);
    rows without hits are unchanged, null text stays null, repeated rows are changed alike, other columns are kept whatever
    their names; an empty table or benchmark changes nothing."""
    row, hits = spare("_row", docs), spare("_hits", docs)
    found = (find_hits(docs, benchmark, id_col, text_col, **kw).where("size(hits) > 0")
             .select(F.col("text_hash").alias(row), F.col("hits").alias(hits)).dropDuplicates([row]))
    both = docs.join(stored(found, "hits"), F.xxhash64(F.col(f"`{text_col}`")) == F.col(row), "left")
    t = f"`{text_col}`"
    lead = rf"regexp_extract({t}, '^{SEPARATORS_ANY_CASE}', 0)"
    words = rf"array_remove(split({t}, r'{SEPARATORS_ANY_CASE}'), '')"
    gaps = rf"regexp_extract_all({t}, r'(?<=[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]){SEPARATORS_ANY_CASE}', 0)"
    lead = lead.replace("'^", "r'^")
    cut = F.expr(f"""concat({lead}, array_join(transform({words}, (x, i) -> concat(
        CASE WHEN exists({hits}, h -> h.pos <= i AND i < h.pos + h.len) THEN '' ELSE x END,
        coalesce(get({gaps}, i), ''))), ''))""")
    return both.withColumn(text_col, F.when(F.col(hits).isNotNull(), cut).otherwise(F.col(text_col))).select(*docs.columns)
