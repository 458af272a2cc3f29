"""From documents to sentences and typed tokens.

Raw document rows are hash-partitioned by document once (``scale.cluster``). Sentences and tokens are made
by ``posexplode`` on top of that, so windows over ``(document, sentence)`` find their rows already together
and no token is ever shuffled for them. A sentence is never larger than the one text cell it came from.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.plans.scale import cluster, stored

IDS = ("doc_id",)


def sentence_window(ids: Sequence[str] = IDS) -> Window:
    return Window.partitionBy(*ids, "sent_no").orderBy("tok_no")


def sentences(df: DataFrame, text: str = "text", ids: Sequence[str] = IDS) -> DataFrame:
    """P1. ``ids, sent_no, text``."""
    parts = df.select(*ids, F.posexplode(tx.split_sentences(F.col(text))).alias("_at", "text"))
    return parts.select(*ids, (F.col("_at") + 1).cast("int").alias("sent_no"), "text")


def sentences_freq(df: DataFrame, text: str = "text", ids: Sequence[str] = IDS) -> DataFrame:
    """P2. The corpus-count split: lone numbers are blanked first and any white space ends a sentence."""
    parts = tx.split_sentences(tx.blank_numbers(F.col(text)), r"\s+")
    out = df.select(*ids, F.posexplode(parts).alias("_at", "text"))
    return out.select(*ids, (F.col("_at") + 1).cast("int").alias("sent_no"), "text")


def tokenize(s: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """P3. One row per word or mark: ``surface, lower, punct_type, preceded_by_apostrophe``.

    ``punct_type`` is null for words. A straight quote has type ``QUOTE`` until ``quote_direction``.
    """
    rows = s.select(*ids, "sent_no", F.posexplode(tx.token_strings(F.col("text"))).alias("_at", "_raw"))
    return _typed(rows, F.col("_raw"), ids)


def _surface(raw: Column) -> Column:
    return F.when(raw == tx.CLOSING, "’").when(_after_apostrophe(raw), F.ltrim(raw, F.lit("'’"))).otherwise(raw)


def _after_apostrophe(raw: Column) -> Column:
    return (F.length(raw) > 1) & (raw.startswith("'") | raw.startswith("’"))


def _typed(rows: DataFrame, raw: Column, ids: Sequence[str], more: Sequence[str] = ()) -> DataFrame:
    rows = rows.select(
        *ids,
        "sent_no",
        (F.col("_at") + 1).cast("int").alias("tok_no"),
        _surface(raw).alias("surface"),
        F.when(raw == tx.CLOSING, "QUOTE_CLOSE").otherwise(tx.mark_type(raw)).alias("punct_type"),
        _after_apostrophe(raw).alias("preceded_by_apostrophe"),
        *more,
    )
    return rows.withColumn("lower", tx.fold(F.col("surface")))


def tokenize_with(s: DataFrame, lookup: str, out: str, ids: Sequence[str] = IDS) -> DataFrame:
    """P3 with ``out``: what the map column ``lookup`` of the sentence has for the token's ``lower``.

    The map is read inside the sentence's row, before its tokens become rows, so no token is shuffled or joined.
    """
    raws = tx.token_strings(F.col("text"))
    both = F.transform(raws, lambda r: F.struct(r.alias("raw"), F.element_at(F.col(lookup), tx.fold(_surface(r))).alias("found")))
    rows = s.select(*ids, "sent_no", F.posexplode(both).alias("_at", "_t")).withColumn(out, F.col("_t.found"))
    return _typed(rows, F.col("_t.raw"), ids, [out])


def split_fused(s: DataFrame, forms: list[str], text: str = "text") -> DataFrame:
    """P5. Cut known forms glued to the next word, before tokenising."""
    return s.withColumn(text, tx.split_fused(F.col(text), forms))


def clean_tokens(s: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """P6. Words for corpus counts, one row each."""
    raw = s.select(*ids, "sent_no", F.explode(tx.raw_frequency_words(F.col("text"))).alias("_raw"))
    words = raw.where(F.length("_raw") > 1).select(*ids, "sent_no", tx.word_of(F.col("_raw")).alias("word"))
    return words.where(~F.col("word").rlike(r"^\d+$"))


def quote_direction(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """W4. A straight quote opens if no quote is open before it, else it closes.

    Directed marks reset the state; straight ones toggle it. So the direction is the parity of straight
    quotes since the last directed one, shifted if that one opened.
    """
    w = sentence_window(ids)
    kind = F.col("punct_type")
    directed = kind.isin("QUOTE_OPEN", "QUOTE_CLOSE")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    straight = F.sum((kind == "QUOTE").cast("int")).over(before)
    state = t.withColumn("_q", F.coalesce(straight, F.lit(0)))
    last = F.last(F.when(directed, F.struct(kind.alias("k"), F.col("_q").alias("q"))), True).over(before)
    state = state.withColumn("_d", last)
    toggles = F.col("_q") - F.coalesce(F.col("_d.q"), F.lit(0)) + F.coalesce(
        (F.col("_d.k") == "QUOTE_OPEN").cast("int"), F.lit(0)
    )
    resolved = F.when(kind == "QUOTE", F.when(toggles % 2 == 1, "QUOTE_CLOSE").otherwise("QUOTE_OPEN")).otherwise(kind)
    return state.withColumn("punct_type", resolved).drop("_q", "_d")


def proper_flags(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """W2. ``is_initial`` and ``is_proper_noun``; expects directed quotes.

    A closing quote right after a sentence end still counts as that end, so the test looks at the last
    token that is not a closing quote.
    """
    w = sentence_window(ids)
    kind = F.coalesce(F.col("punct_type"), F.lit("WORD"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    last_kind = F.last(F.when(kind != "QUOTE_CLOSE", kind), True).over(before)
    previous = F.lag(kind).over(w)
    initial = (
        previous.isNull() | (previous == "QUOTE_OPEN") | F.coalesce(last_kind.isin(*tx.TERMINAL), F.lit(False))
    )
    capital = F.col("punct_type").isNull() & F.col("surface").rlike("^[A-Z]")
    out = t.withColumn("is_initial", initial)
    return out.withColumn(
        "is_proper_noun", capital & (~F.col("is_initial") | F.col("lower").contains("l"))
    )


def boundary_flags(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """Sentence and clause boundary flags of marks, and the open/close flags of quotes."""
    w = sentence_window(ids)
    kind = F.coalesce(F.col("punct_type"), F.lit("WORD"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    last_kind = F.last(F.when(kind != "QUOTE_CLOSE", kind), True).over(upto)
    ends = kind.isin(*tx.TERMINAL) | ((kind == "QUOTE_CLOSE") & F.coalesce(last_kind.isin(*tx.TERMINAL), F.lit(False)))
    return t.select(
        "*",
        ends.alias("is_sent_boundary"),
        kind.isin(*tx.CLAUSE).alias("is_clause_boundary"),
        (kind == "QUOTE_OPEN").alias("is_quote_open"),
        (kind == "QUOTE_CLOSE").alias("is_quote_close"),
    )


def whole_documents(df: DataFrame, text: str = "text", ids: Sequence[str] = IDS) -> DataFrame:
    """``ids, _texts``: one row per document on its partition; rows that share their ids are one document, as windows see them."""
    return gathered(cluster(df, *ids), text, ids)


def gathered(docs: DataFrame, text: str = "text", ids: Sequence[str] = IDS) -> DataFrame:
    """``whole_documents`` of documents that are hash-partitioned already."""
    return docs.groupBy(*ids).agg(F.collect_list(text).alias("_texts"))


def _side_by_side(lists: Column, which: Column) -> Column:
    """What the lists have at place ``which``, counted from 0."""
    return F.filter(F.transform(lists, lambda x: F.get(x, which)), lambda x: x.isNotNull())


def _places(lists: Column) -> Column:
    most = F.array_max(F.transform(lists, lambda x: F.size(x)))
    return F.when(most > 0, F.sequence(F.lit(0), most - 1)).otherwise(F.array().cast("array<int>"))


def sentence_groups(docs: DataFrame, ids: Sequence[str] = IDS, fused: list[str] | None = None) -> DataFrame:
    """``ids, sent_no, _parts`` of ``whole_documents``: the sentence, or those that share its number."""
    def split(t: Column) -> Column:
        return F.transform(tx.split_sentences(t), lambda s: tx.split_fused(s, fused)) if fused else tx.split_sentences(t)

    lists = F.transform("_texts", split)
    many = F.transform(_places(lists), lambda k: _side_by_side(lists, k))
    groups = F.when(F.size("_texts") == 1, F.transform(split(F.col("_texts")[0]), lambda s: F.array(s))).otherwise(many)
    rows = docs.select(*ids, F.posexplode(groups).alias("_at", "_parts"))
    return rows.select(*ids, (F.col("_at") + 1).cast("int").alias("sent_no"), "_parts")


#: One letter per token for what the flags ask: terminal mark, straight, opening or closing quote, or none of these.
CODES = {"QUOTE": "Q", "QUOTE_OPEN": "O", "QUOTE_CLOSE": "C", **dict.fromkeys(tx.TERMINAL, "T")}


def _code(raw: Column) -> Column:
    marks = {c: [m for m, kind in tx.MARKS.items() if CODES.get(kind) == c] for c in "TQOC"}
    code = F.when(F.length(raw) > 2, "x")
    for c, listed in marks.items():
        code = code.when(raw.isin(*listed, *([tx.CLOSING] if c == "C" else [])), c)
    return code.otherwise("x")


def directed_codes(raws: Column) -> Column:
    """The codes of a sentence as one text, straight quotes directed, ``c`` for a closing quote that still belongs to the end
    before it.

    A straight quote opens if no quote is open before it: an opening one is closed by the next quote if that is straight.
    """
    codes = F.array_join(F.transform(raws, _code), "")
    paired = F.replace(F.regexp_replace(codes, "([OQ])([^OQC]*+)Q", "O$2C"), F.lit("Q"), F.lit("O"))
    codes = F.when(codes.contains("Q"), paired).otherwise(codes)
    return F.when(codes.contains("TC"), F.regexp_replace(codes, r"(?:(?<=T)|(?!^)\G)C", "c")).otherwise(codes)


def flagged_tokens(s: DataFrame, ids: Sequence[str] = IDS, lookup: str | None = None, out: str = "_tag") -> DataFrame:
    """P3, W4, W2 and boundary flags of ``sentence_groups``: ``flagged(tokenize(s))`` inside the sentence's row, with no window.

    Of sentences that share their number the tokens are taken place by place. With ``lookup`` also ``out``: what that map
    column of the sentence has for the token's ``lower``.
    """
    lists = F.transform("_parts", tx.token_strings)
    merged = F.flatten(F.transform(_places(lists), lambda k: F.transform(_side_by_side(lists, k), lambda r: F.struct(k.alias("at"), r.alias("raw")))))
    one = F.size("_parts") == 1
    more = [lookup] if lookup else []
    rows = s.select(*ids, "sent_no", *more, F.when(one, tx.token_strings(F.col("_parts")[0])).alias("_one"), F.when(~one, merged).alias("_merged"))
    rows = rows.select(*ids, "sent_no", *more, F.coalesce("_one", "_merged.raw").alias("_raws"), F.col("_merged.at").alias("_ats"))
    rows = rows.select("*", directed_codes(F.col("_raws")).alias("_codes"))
    before = F.concat(F.lit("^"), F.substr("_codes", F.lit(1), F.length("_codes") - 1))
    columns = [F.col("_raws").alias("raw"), F.split("_codes", "").alias("code"), F.split(before, "").alias("before")]
    if lookup:
        columns.append(F.transform("_raws", lambda r: F.element_at(F.col(lookup), tx.fold(_surface(r)))).alias("found"))
    named = rows.select(*ids, "sent_no", "_ats", *columns)
    zipped = F.arrays_zip(*[c for c in ("raw", "code", "before", *(["found"] if lookup else []))])
    rows = named.select(*ids, "sent_no", "_ats", F.posexplode(zipped).alias("_pos", "_t"))
    rows = rows.withColumn("_at", F.coalesce(F.get("_ats", F.col("_pos")), F.col("_pos")))
    if lookup:
        rows = rows.withColumn(out, F.col("_t.found"))
    t = _typed(rows.withColumns({"_code": F.col("_t.code"), "_before": F.col("_t.before")}), F.col("_t.raw"), ids, ["_code", "_before", *([out] if lookup else [])])
    code, before = F.col("_code"), F.col("_before")
    kind = F.when(F.col("punct_type") == "QUOTE", F.when(code == "O", "QUOTE_OPEN").otherwise("QUOTE_CLOSE")).otherwise(F.col("punct_type"))
    t = t.withColumn("punct_type", kind).withColumn("is_initial", before.isin("^", "O", "T", "c"))
    capital = F.col("punct_type").isNull() & F.col("surface").rlike("^[A-Z]")
    t = t.withColumn("is_proper_noun", capital & (~F.col("is_initial") | F.col("lower").contains("l")))
    return t.select(
        *[c for c in t.columns if c not in ("_code", "_before")], code.isin("T", "c").alias("is_sent_boundary"),
        F.coalesce(F.col("punct_type").isin(*tx.CLAUSE), F.lit(False)).alias("is_clause_boundary"), (code == "O").alias("is_quote_open"),
        code.isin("C", "c").alias("is_quote_close"),
    )


def tokens(df: DataFrame, text: str = "text", ids: Sequence[str] = IDS, fused: list[str] | None = None) -> DataFrame:
    """The full token table of a document table: P1, P5, P3, W4, W2 and boundary flags."""
    return flagged_tokens(sentence_groups(whole_documents(df, text, ids), ids, fused), ids)


def flagged(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """Tokens of ``tokenize`` with directed quotes, name flags and boundary flags."""
    return boundary_flags(proper_flags(quote_direction(t, ids), ids), ids)


def content(column: Column) -> Column:
    """``column`` on words, null on marks: the input of neighbour windows that skip marks."""
    return F.when(F.col("punct_type").isNull(), column)


def with_context(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """W1. Previous and next token, previous and next word, and whether a comma stands right before."""
    part = ", ".join([*ids, "sent_no"])
    over = f"over (partition by {part} order by tok_no)"
    word = "case when punct_type is null then lower end"
    return t.select(
        "*",
        F.expr(f"lag(lower) {over}").alias("prev_lower"),
        F.expr(f"lead(lower) {over}").alias("next_lower"),
        F.expr(f"lag({word}) ignore nulls {over}").alias("prev_word"),
        F.expr(f"lead({word}) ignore nulls {over}").alias("next_word"),
        F.expr(f"coalesce(lag(punct_type) {over} = 'COMMA', false)").alias("preceded_by_comma"),
        F.expr(f"lead(punct_type) {over}").alias("next_punct"),
    )


def propagate_proper(t: DataFrame, doc: Sequence[str] = IDS) -> DataFrame:
    """J9. A form confirmed as a name inside a sentence is a name everywhere in its document."""
    w = Window.partitionBy(*doc, "lower")
    confirmed = F.max(F.col("is_proper_noun")).over(w)
    noun = F.col("pos") == "NOUN" if "pos" in t.columns else F.col("punct_type").isNull()
    out = t.withColumn("_confirmed", confirmed)
    changed = F.col("_confirmed") & ~F.col("is_proper_noun") & noun
    if "noun_class" in t.columns:
        out = out.withColumn("noun_class", F.when(changed, None).otherwise(F.col("noun_class")))
    return out.withColumn("is_proper_noun", F.col("is_proper_noun") | changed).drop("_confirmed")


def counted_pieces(s: DataFrame) -> DataFrame:
    """``n, sent_no, text``: the distinct pieces between blanks of all sentences and how often each occurs.

    No token reaches over a blank but one after an apostrophe, where nothing is cut. So ``tokenize`` finds in the pieces
    what it finds in the sentences, once per piece.
    """
    pieces = s.select(F.explode(tx.blank_pieces(F.col("text"))).alias("text")).where(F.col("text") != "")
    return pieces.groupBy("text").agg(F.count(F.lit(1)).alias("n")).select("n", F.lit(1).alias("sent_no"), "text")


def vocabulary(t: DataFrame, times: str | None = None) -> DataFrame:
    """Distinct words with their count: word-level work is done once per form, not once per token.

    ``times`` names the column that says how often a row of ``t`` stands.
    """
    n = F.sum(times) if times else F.count(F.lit(1))
    return t.where(F.col("punct_type").isNull()).groupBy(F.col("lower").alias("word")).agg(n.alias("n"))


def stored_vocabulary(s: DataFrame) -> DataFrame:
    """``vocabulary(tokenize(s))`` of sentences, written once: tests of a word run once per form and not, pushed below the
    count, once per token, and a query that reads the vocabulary several times reads no text again."""
    return stored(vocabulary(tokenize(counted_pieces(s), ["n"]), "n"), "vocabulary")
