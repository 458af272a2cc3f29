"""Grammar and punctuation rules over tagged tokens.

Input: tokens with boundary flags plus ``pos, noun_class, pron_type, stem, verb_tense, obj_class``. Everything
looks at one sentence, whose rows are already together (see ``tokens``), so the rules are window columns on
one scan. What the windows of several operators ask of each other is worked out level by level, with one window step
for each (``together``). Each rule becomes a nullable struct; ``errors`` explodes the non-null ones of a row. There is one
pass over the tokens however many rules are on.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import zip_longest

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.plans.scale import bounded, local_table
from lexweave.sources import fixed

IDS = ("doc_id",)
VERBS = ("VERB_CONJ", "VERB_INF")


@dataclass(frozen=True)
class RuleTables:
    """The word lists of the rules; any language can be put in."""

    roles: tuple = tuple(fixed.RULE_WORDS)
    connectors: tuple = tuple((n, c) for n, _, _, _, c, _ in fixed.NOUN_CLASSES)
    elided: tuple = tuple(fixed.ELIDED_CONNECTORS)
    elision: tuple = tuple(fixed.ELISION)
    concords: tuple = tuple((n, a) for n, _, _, a, _, _ in fixed.NOUN_CLASSES)
    place_copula: tuple = (("mu", "muri"), ("ku", "kuri"))
    place_long: tuple = ("muri",)
    destination: tuple = ("i",)
    walk_stems: tuple = ("gend", "end")
    go_stems: tuple = ("jy", "giy")
    past_tenses: tuple = field(default=("PAST_PERF", "PAST_PERF_LOC", "PAST_IMPF", "COPULA_PAST"))

    def words(self, *names: str) -> list[str]:
        return sorted({w for w, role in self.roles if role in names})

    def has(self, column: Column, *names: str) -> Column:
        listed = self.words(*names)
        return column.isin(*listed) if listed else F.lit(False)

    def connector(self, noun_class: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in self.connectors for x in pair]), noun_class)

    def elided_class(self, word: Column) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for pair in self.elided for x in pair]), word)


RULES = RuleTables()


def over(ids: Sequence[str], extra: str = "") -> str:
    part = ", ".join([*ids, "sent_no"]) + (f", {extra}" if extra else "")
    return f"over (partition by {part} order by tok_no)"


def _window(ids: Sequence[str], *extra: str) -> Window:
    return Window.partitionBy(*ids, "sent_no", *extra).orderBy("tok_no")


def _whole(ids: Sequence[str]) -> Window:
    """All of a sentence, in the order of its tokens: a window of its own without an order would be a step of its own."""
    return _window(ids).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


#: The new columns of an operator, level by level: windows and plain columns in turn, each from what is there before.
Levels = Iterator[dict[str, Column]]


def together(t: DataFrame, *operators: Levels) -> DataFrame:
    """``t`` and the columns of all operators, with one window step per level. Names with an underscore are dropped at the end."""
    own = t.columns
    for level in zip_longest(*operators, fillvalue={}):
        new = {name: column for part in level for name, column in part.items()}
        if new:
            t = t.select("*", *[column.alias(name) for name, column in new.items()])
    return t.drop(*[c for c in t.columns if c.startswith("_") and c not in own])


# What the rules ask of each neighbour; narrower structs make narrower rows in every window.
NEIGHBOURS = {
    "p1": ("lag", 1, "pos noun_class punct_type"),
    "p2": ("lag", 2, "pos noun_class pron_type lower"),
    "p3": ("lag", 3, "pos noun_class"),
    "n1": ("lead", 1, "tok_no pos punct_type lower"),
    "pc": ("lag", 1, "tok_no pos stem"),
    "nc": ("lead", 1, "tok_no pos pron_type lower is_proper_noun"),
    "nc2": ("lead", 2, "pos is_proper_noun"),
}


def context(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """Neighbour structs of every token: ``p1..p3`` and ``n1`` any token, ``pc``, ``nc``, ``nc2`` words only."""
    return together(t, _context(ids))


def _context(ids: Sequence[str]) -> Levels:
    o = over(ids)

    def neighbour(name: str) -> Column:
        side, offset, fields = NEIGHBOURS[name]
        me = "named_struct(" + ", ".join(f"'{c}', {c}" for c in fields.split()) + ")"
        if name in ("pc", "nc", "nc2"):
            return F.expr(f"{side}(case when punct_type is null then {me} end, {offset}) ignore nulls {o}").alias(name)
        return F.expr(f"{side}({me}, {offset}) {o}").alias(name)

    yield {n: neighbour(n) for n in NEIGHBOURS}


def error(kind: str, when: Column, tok: Column | None = None, corrected: Column | None = None) -> Column:
    return F.when(
        when,
        F.struct(
            (F.col("tok_no") if tok is None else tok).cast("int").alias("tok_no"),
            F.lit(kind).alias("type"),
            (F.lit(None) if corrected is None else corrected).cast("string").alias("corrected_word"),
        ),
    )


def errors(t: DataFrame, found: Sequence[Column], ids: Sequence[str] = IDS, numbered: bool = False) -> DataFrame:
    """``ids, sent_no, tok_no, type, corrected_word`` of the rules that hold, from one scan.

    With ``numbered`` also ``error_no``: the place of the rule in ``found``.

    The array is made in a projection of its own and nulls are dropped after the explode: inside a generator
    or a filter lambda the rules would be interpreted, here they are compiled.
    """
    rows = t.select(*ids, "sent_no", F.array(*found).alias("_a"))
    rows = rows.select(*ids, "sent_no", F.posexplode("_a").alias("error_no", "_e")).where(F.col("_e").isNotNull())
    return rows.select(*ids, "sent_no", "_e.*", *(["error_no"] if numbered else []))


def is_word() -> Column:
    return F.col("punct_type").isNull()


def compatible(a: Column, b: Column) -> Column:
    """A noun of class ``a`` may stand with a verb of subject class ``b``."""
    return (
        (a == b)
        | (a.isin(1, 3) & b.isin(1, 3))
        | (a.isin(4, 9) & b.isin(4, 9))
        | (a.isin(9, 10) & b.isin(9, 10))
        | ((b == 6) & a.isin(1, 3, 9))
    )


def build_adjective(noun_class: Column, stem: Column, rules: RuleTables = RULES) -> Column:
    """The adjective that agrees: class concord plus stem, u to w and i to y before a vowel."""
    table = F.create_map(*[F.lit(x) for pair in rules.concords for x in pair])
    concord = F.element_at(table, noun_class)
    glide = F.regexp_replace(F.regexp_replace(F.regexp_replace(concord, "^ki$", "cy"), "u$", "w"), "i$", "y")
    gliding = stem.rlike(f"^[{tx.VOWELS}]") & noun_class.isin(1, 3, 4, 7, 8, 11, 13, 14, 15)
    return F.concat(F.when(gliding, glide).otherwise(concord), stem)


# --- W5 -----------------------------------------------------------------------------------------------


def agreement_rules(r: RuleTables = RULES) -> list[Column]:
    cls, p1 = F.col("noun_class"), F.col("p1")
    noun_before = (F.col("p1.pos") == "NOUN") & F.col("p1.noun_class").isNotNull()
    adjective = noun_before & (F.col("pos") == "ADJECTIVE") & cls.isNotNull() & (F.col("p1.noun_class") != cls)
    possessive = (F.col("pos") == "PRONOUN") & F.col("pron_type").isin("POSSESSIVE", "REFLEXIVE") & cls.isNotNull()
    nine_ten = cls.isin(9, 10) & F.col("p1.noun_class").isin(9, 10) & (F.col("p1.noun_class") != cls)
    own = r.connector(cls)
    before = F.when(
        (F.col("p2.pos") == "PRONOUN") & F.col("p2.pron_type").isin("POSSESSIVE", "REFLEXIVE"), F.col("p2.noun_class")
    ).when(F.col("p2.pos") == "CONJUNCTION", r.elided_class(F.col("p2.lower")))
    chain = (
        (r.connector(before) == own)
        & (F.col("p3.pos") == "NOUN")
        & (r.connector(F.col("p3.noun_class")) == own)
    )
    wrong = noun_before & possessive & ~nine_ten & (r.connector(F.col("p1.noun_class")) != own)
    corrected = F.when(F.col("stem").isNotNull(), build_adjective(p1["noun_class"], F.col("stem"), r))
    return [
        error("ADJ_AGREEMENT", adjective, corrected=corrected),
        error("POSS_AGREEMENT", wrong & ~F.coalesce(chain, F.lit(False))),
    ]


def agreement(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W5. Noun with adjective, noun with possessive; a chain head two tokens back may own the connector."""
    return errors(context(t, ids), agreement_rules(rules), ids)


# --- W6 -----------------------------------------------------------------------------------------------


SKIPPED = ("ADJECTIVE", "ADVERB", "CONJUNCTION", "LOCATIVE", "PRONOUN")


def _skipped() -> Column:
    """Tokens that the search for a subject passes over."""
    marks = ~(F.col("is_sent_boundary") | F.col("is_clause_boundary"))
    return F.when(~is_word(), marks).otherwise(F.col("pos").isin(*SKIPPED))


def subject_columns(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """``subj``: the token the search for a subject ends at, with the classes found before it.

    ``seen`` is the set of noun and verb classes before a token up to the last sentence end (at most as many
    as there are classes), ``human_before`` whether a class 1/3 one stands before an earlier conjunction.
    """
    w = _window(ids)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = t.withColumn("_seg", F.coalesce(F.sum(F.col("is_sent_boundary").cast("int")).over(before), F.lit(0)))
    role = F.col("gram_role") if "gram_role" in t.columns else F.lit(None).cast("string")
    bears = F.col("noun_class").isNotNull() & (
        (F.col("pos") == "NOUN")
        | ((F.col("pos") == "VERB_CONJ") & (F.coalesce(role, F.lit("")) != "VERBAL_NOUN"))
    )
    inside = _window(ids, "_seg").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_seen", F.collect_set(F.when(bears, F.col("noun_class"))).over(inside))
    human = (F.col("pos") == "CONJUNCTION") & F.arrays_overlap("_seen", F.array(F.lit(1), F.lit(3)))
    s = s.withColumn("_human", F.coalesce(F.max(human).over(inside), F.lit(False)))
    s = s.withColumn("_skip", _skipped())
    stop = (
        "case when not _skip then named_struct('pos', pos, 'noun_class', noun_class, 'seen', _seen, "
        "'human', _human) end"
    )
    return s.withColumn("subj", F.expr(f"lag({stop}) ignore nulls {over(ids)}")).drop(
        "_seg", "_seen", "_human", "_skip"
    )


def _disagrees(subject: str) -> Column:
    """Whether a verb has another class than the noun in the struct ``subject``."""
    vc, nc = F.col("noun_class"), F.col(f"{subject}.noun_class")
    checked = (
        (F.col("pos") == "VERB_CONJ")
        & vc.isNotNull()
        & (F.col(f"{subject}.pos") == "NOUN")
        & nc.isNotNull()
        & ~F.coalesce(F.col("verb_tense").isin("COPULA_PAST", "COPULA_PRES"), F.lit(False))
        & (F.coalesce(F.col("gram_role"), F.lit("")) != "VERBAL_NOUN")
    )
    return checked & ~compatible(nc, vc)


def subject_verb_rules() -> list[Column]:
    vc = F.col("noun_class")
    remote = F.exists(F.col("subj.seen"), lambda c: compatible(c, vc))
    couple = F.col("subj.human") & (vc == 2) & F.col("subj.noun_class").isin(1, 3)
    return [error("SUBJ_VERB_AGREEMENT", _disagrees("subj") & ~remote & ~couple)]


def subject_verb(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """W6. The nearest noun left of a verb must have its class, unless an earlier noun or verb has.

    Only sentences where some verb has not the class of the nearest noun are searched for earlier ones: the windows of
    ``subject_columns`` sort by parts of sentences, all others follow the tokens.
    """
    t = with_role(t)
    return errors(subject_columns(_doubtful(t, ids), ids), subject_verb_rules(), ids)


def _doubtful(t: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The sentences that have a verb of another class than the nearest noun left of it."""
    s = t.withColumn("_stop", F.when(~_skipped(), F.struct("pos", "noun_class")))
    s = s.withColumn("_near", F.expr(f"lag(_stop) ignore nulls {over(ids)}"))
    s = s.withColumn("_wrong", F.coalesce(_disagrees("_near"), F.lit(False)))
    return s.withColumn("_any", F.max("_wrong").over(_whole(ids))).where("_any").select(t.columns)


def with_role(t: DataFrame) -> DataFrame:
    return t if "gram_role" in t.columns else t.withColumn("gram_role", F.lit(None).cast("string"))


# --- W7 -----------------------------------------------------------------------------------------------


def gram_roles(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W7. Verb roles, and the conditional-clause flag of the first verb within three tokens of a marker."""
    t = with_role(t)
    w = _window(ids)
    pos, lower = F.col("pos"), F.col("lower")
    verb = F.coalesce(pos.isin(*VERBS), F.lit(False))
    conj = F.coalesce(pos == "VERB_CONJ", F.lit(False))
    initial = rules.has(lower, "INITIAL_CONDITIONAL")
    facts = {
        "marker": ((pos == "CONJUNCTION") & rules.has(lower, "CONDITIONAL")) | (initial & (F.col("tok_no") == 1)),
        "initial": initial, "after": pos == "CONJUNCTION", "conj": conj, "verb": verb,
        "particle": (pos == "VERB_PARTICLE") & rules.has(lower, "COMPLEMENT"),
    }
    code = reduce(lambda x, y: x + y, [F.when(c, 1 << i).otherwise(0) for i, c in enumerate(facts.values())])
    s = t.select("*", code.alias("_f"))
    s = s.select("*", *[F.lag("_f", k).over(w).alias(f"_f{k}") for k in (1, 2, 3, 4)])

    def fact(k: int, name: str) -> Column:
        return F.coalesce(F.col(f"_f{k}").bitwiseAND(1 << list(facts).index(name)) != 0, F.lit(False))

    def marked(k: int) -> Column:
        return fact(k, "marker") | (fact(k, "initial") & fact(k + 1, "after"))

    def within(want, stop: str) -> Column:
        """The nearest of the three tokens before for which ``want`` holds, with no ``stop`` token nearer."""
        found, clear = F.lit(False), F.lit(True)
        for k in (1, 2, 3):
            found = found | (clear & want(k))
            clear = clear & ~fact(k, stop)
        return found

    tense, stem = F.col("verb_tense"), F.col("stem")
    role = (
        F.when(~verb, F.col("gram_role"))
        .when(F.col("gram_role") == "VERBAL_NOUN", F.col("gram_role"))
        .when(tense == "NEG_RELATIVE", "PARTICIPIAL")
        .when(tense == "NARRATIVE", "SEQUENTIAL")
        .when(tense.isin("COPULA_PAST", "COPULA_PRES") | stem.isin("b", "ri"), "AUXILIARY")
        .when(within(lambda k: fact(k, "particle"), "verb"), "COMPLEMENT")
        .otherwise("MAIN_VERB")
    )
    return s.select(
        *[c for c in t.columns if c != "gram_role"], role.alias("gram_role"),
        (conj & within(marked, "conj")).alias("is_conditional_clause"),
    )


INDICATIVE = ("PRESENT", "PRESENT_NORA", "PAST_PERF", "PAST_IMPF", "FUTURE")


def purpose_columns(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """``after_purpose``: a purpose particle stands at most four tokens before, only its subject between."""
    return together(t, _purpose(rules, ids))


def _purpose(rules: RuleTables, ids: Sequence[str]) -> Levels:
    w = _window(ids)
    pos = F.col("pos")
    boundary = F.col("is_clause_boundary") | F.col("is_sent_boundary")
    yield {"_after_end": F.lag(boundary).over(w)}
    gir = (F.col("pc.pos") == "VERB_INF") & (F.col("pc.stem") == "gir")
    purpose = (
        (pos == "VERB_PARTICLE")
        & rules.has(F.col("lower"), "PURPOSE")
        & (F.coalesce(gir, F.lit(False)) | ((F.col("tok_no") > 1) & ~F.coalesce("_after_end", F.lit(False))))
    )
    passable = F.when(~is_word(), ~boundary).otherwise(F.coalesce(pos.isin("NOUN", "PRONOUN"), F.lit(False)))
    yield {"_q": F.when(purpose, 2).otherwise(0) + F.when(passable, 1).otherwise(0)}
    yield {f"_q{k}": F.lag("_q", k).over(w) for k in (1, 2, 3, 4)}
    found, clear = F.lit(False), F.lit(True)
    for k in (1, 2, 3, 4):
        found = found | (clear & F.coalesce(F.col(f"_q{k}") >= 2, F.lit(False)))
        clear = clear & F.coalesce(F.col(f"_q{k}") % 2 == 1, F.lit(False))
    yield {"after_purpose": found}


def purpose_rules() -> list[Column]:
    wrong = (F.col("pos") == "VERB_CONJ") & F.col("after_purpose") & F.col("verb_tense").isin(*INDICATIVE)
    return [error("WRONG_VERB_MOOD", wrong)]


def clause_rules(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W7. A purpose particle asks for the subjunctive."""
    return errors(purpose_columns(context(t, ids), rules, ids), purpose_rules(), ids)


# --- W8 -----------------------------------------------------------------------------------------------


def pair_rule_columns(r: RuleTables = RULES) -> list[Column]:
    pos, lower = F.col("pos"), F.col("lower")
    vowel_next = F.col("n1.lower").rlike(f"^[{tx.VOWELS}]")
    full = [f for f, _ in r.elision]
    elide = (
        is_word()
        & lower.isin(*full)
        & F.col("n1.punct_type").isNull()
        & F.col("n1.tok_no").isNotNull()
        & (F.coalesce(F.col("n1.pos"), F.lit("")) != "NUMBER")
        & vowel_next
    )
    place = pos == "LOCATIVE"
    personal = (F.col("nc.pos") == "PRONOUN") & (F.col("nc.pron_type") == "PERSONAL")
    common = (F.col("nc.pos") == "NOUN") & ~F.col("nc.is_proper_noun")
    short = place & lower.isin(*[a for a, _ in r.place_copula]) & personal
    long = place & lower.isin(*r.place_long) & common
    conj = pos == "VERB_CONJ"
    walk, go = conj & F.col("stem").isin(*r.walk_stems), conj & F.col("stem").isin(*r.go_stems)
    aimed = (
        walk
        & (F.col("nc.pos") == "LOCATIVE")
        & F.col("nc.lower").isin(*r.destination)
        & (F.col("nc2.is_proper_noun") | (F.col("nc2.pos") == "NOUN"))
    )
    return [
        error("VOWEL_HIATUS", elide),
        error("WRONG_LOCATIVE", short | long),
        error("VERB_SELECTION", (walk & common) | aimed),
        error("MISSING_LOCATIVE", go & common),
    ]


def pair_rules(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W8. Rules on two words side by side: elision, locative form, verb of motion."""
    return errors(context(t, ids), pair_rule_columns(rules), ids)


# --- W10 ----------------------------------------------------------------------------------------------


def comma_rule_columns(r: RuleTables = RULES) -> list[Column]:
    lower = F.col("lower")
    comma_before = F.coalesce(F.col("p1.punct_type") == "COMMA", F.lit(False))
    bare = is_word() & (F.col("tok_no") > 1) & ~comma_before
    both_verbs = F.col("pc.pos").isin(*VERBS) & F.col("nc.pos").isin(*VERBS)
    extra = (
        (F.col("punct_type") == "COMMA") & (F.col("pc.pos") == "NOUN") & (F.col("nc.pos") == "ADJECTIVE")
    )
    return [
        error("MISSING_COMMA", bare & r.has(lower, "ADVERSATIVE")),
        error("MISSING_COMMA", bare & r.has(lower, "COORDINATOR") & both_verbs),
        error("MISSING_COMMA", bare & r.has(lower, "SEQUENTIAL") & (F.col("pc.pos") == "VERB_CONJ")),
        error("EXTRA_PUNCT", extra),
    ]


def comma_rules(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W10. Commas before adversatives, coordinators of verbs and sequentials; none inside noun + adjective."""
    return errors(context(t, ids), comma_rule_columns(rules), ids)


# --- W11 and A6-A8 ------------------------------------------------------------------------------------


def sentence_columns(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """Running marks of a sentence (clause predicate, parenthesis depth) and its totals, on every token."""
    t = with_role(t)
    return together(t, _sentence(rules, ids))


def _sentence(rules: RuleTables, ids: Sequence[str]) -> Levels:
    w, whole = _window(ids), _whole(ids)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    kind, pos, lower = F.col("punct_type"), F.col("pos"), F.col("lower")
    predicate = F.coalesce((pos == "VERB_CONJ") | rules.has(lower, "COPULA"), F.lit(False))
    verbal = F.coalesce(F.col("gram_role") != "VERBAL_NOUN", F.lit(True))
    word = is_word()
    light = pos.isin("INTERJECTION", "ADVERB", "ADVERB_TIME", "VERB_PARTICLE", "CONJUNCTION")
    counted = word & (F.coalesce(pos, F.lit("")) != "NUMBER")
    nominal = pos.isin("NOUN", "RELATIVE_NOUN", "ADJECTIVE", "PRONOUN", "ADVERB", "ADVERB_TIME", "LOCATIVE", "PREPOSITION")

    def any_of(c: Column) -> Column:
        return F.coalesce(F.max(F.coalesce(c, F.lit(False))).over(whole), F.lit(False))

    def count(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)).over(whole)

    yield {
        "_verbs": F.sum(predicate.cast("int")).over(upto),
        "depth": F.sum(F.when(kind == "PAREN_OPEN", 1).when(kind == "PAREN_CLOSE", -1).otherwise(0)).over(upto),
        "last_tok": F.max("tok_no").over(whole),
        "last_word": F.max(F.when(word, F.col("tok_no"))).over(whole),
        "first_word": F.min(F.when(word, F.struct("tok_no", "lower"))).over(whole),
        "last_inner": F.max(F.when(~F.col("is_sent_boundary"), F.col("tok_no"))).over(whole),
        "final_mark": F.max(F.when(F.col("is_sent_boundary"), F.struct("tok_no", "punct_type"))).over(whole),
        "has_verb": any_of((pos == "VERB_INF") | ((pos == "VERB_CONJ") & verbal)),
        "asks": any_of(word & rules.has(lower, "INTERROGATIVE")),
        "_exclaims": any_of(word & rules.has(lower, "EXCLAMATIVE")),
        "content_count": count(counted),
        "all_light": ~any_of(word & ~F.coalesce(light, F.lit(False))),
        "has_noun": any_of(pos.isin("NOUN", "RELATIVE_NOUN")),
        "has_adjective": any_of(pos == "ADJECTIVE"),
        "all_nominal": ~any_of(counted & ~F.coalesce(nominal, F.lit(False))),
        "quotes_open": count(kind == "QUOTE_OPEN"),
        "quotes_close": count(kind == "QUOTE_CLOSE"),
        "parens_open": count(kind == "PAREN_OPEN"),
        "parens_close": count(kind == "PAREN_CLOSE"),
    }
    ends = F.col("is_sent_boundary") | F.coalesce(kind == "SEMICOLON", F.lit(False))
    initial = rules.has(F.col("first_word.lower"), "INITIAL_EXCLAMATIVE")
    yield {
        "_at_end": F.when(ends, F.col("_verbs")),
        "_closing": F.when((kind == "PAREN_CLOSE") & (F.col("depth") == 0), F.col("tok_no")),
        "exclaims": F.col("_exclaims") | F.coalesce(initial, F.lit(False)),
    }
    flanked = (kind == "DASH") & F.col("pc.tok_no").isNotNull() & F.col("nc.tok_no").isNotNull()
    yield {
        "_next_end": F.expr(f"lead(_at_end) ignore nulls {over(ids)}"),
        "_last_end": F.expr(f"lag(_at_end) ignore nulls {over(ids)}"),
        "_all": F.max("_verbs").over(whole),
        "closes_at": F.expr(f"lead(_closing) ignore nulls {over(ids)}"),
        "prose_dashes": count(flanked),
    }
    # predicates counted up to the clause's own end, less those up to the end before it
    yield {"clause_ok": F.coalesce("_at_end", "_next_end", "_all") > F.coalesce("_last_end", F.lit(0))}
    yield {"next_clause_ok": F.lead("clause_ok").over(w)}


def clause_punct_rules(r: RuleTables = RULES) -> list[Column]:
    kind, lower = F.col("punct_type"), F.col("lower")
    led = F.coalesce(F.col("n1.punct_type").isin("COLON", "QUOTE_OPEN"), F.lit(False))
    listing = (
        is_word()
        & r.has(lower, "LIST_PREDICATE")
        & F.col("nc.tok_no").isNull()
        & (F.col("final_mark.punct_type") == "PERIOD")
    )
    semicolon = kind == "SEMICOLON"
    connector = r.has(F.col("nc.lower"), "ADVERSATIVE", "COORDINATOR", "SEQUENTIAL")
    halves = F.col("clause_ok") & F.coalesce("next_clause_ok", F.lit(False))
    inner = kind.isin(*tx.TERMINAL) & (F.col("depth") > 0) & (F.col("last_word") > F.col("closes_at"))
    return [
        error("MISSING_COLON", is_word() & r.has(lower, "SPEECH") & ~led),
        error("MISSING_COLON", listing),
        error("WRONG_PUNCT", semicolon & connector),
        error("WRONG_PUNCT", semicolon & ~halves),
        error("WRONG_PUNCT", inner),
    ]


def last_row() -> Column:
    return F.col("tok_no") == F.col("last_tok")


def attach() -> Column:
    """The token a whole-sentence mark error hangs on: the last one that is no sentence end."""
    return F.coalesce("last_inner", F.lit(1))


def balance_rules() -> list[Column]:
    return [
        error("UNBALANCED_QUOTE", last_row() & (F.col("quotes_open") != F.col("quotes_close")), attach()),
        error("UNBALANCED_PAREN", last_row() & (F.col("parens_open") != F.col("parens_close")), attach()),
        error("WRONG_PUNCT", last_row() & (F.col("prose_dashes") % 2 != 0), attach()),
    ]


def terminal_rules() -> list[Column]:
    period = F.col("final_mark.punct_type") == "PERIOD"
    at = F.col("final_mark.tok_no")
    return [
        error("MISSING_QMARK", last_row() & F.col("asks") & period, at),
        error("MISSING_EXCLAIM", last_row() & F.col("exclaims") & ~F.col("asks") & period, at),
        error(
            "MISSING_PERIOD",
            last_row() & F.col("final_mark").isNull() & F.col("last_word").isNotNull(),
            F.col("last_word"),
        ),
    ]


def no_verb_rules() -> list[Column]:
    excused = (
        F.col("all_light")
        | (F.col("content_count") <= 1)
        | (F.col("has_noun") & F.col("has_adjective") & F.col("all_nominal"))
    )
    return [error("NO_VERB", last_row() & ~F.col("has_verb") & ~excused, F.lit(-1))]


def _sentence_errors(t: DataFrame, rules: RuleTables, ids: Sequence[str], found: list[Column]) -> DataFrame:
    return errors(sentence_columns(context(t, ids), rules, ids), found, ids)


def clause_punct(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W11. Colon, semicolon and parenthesis rules."""
    return _sentence_errors(t, rules, ids, clause_punct_rules(rules))


def balance_check(t: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """A7. Quotes and parentheses in pairs, dashes inside prose in pairs."""
    return _sentence_errors(t, RULES, ids, balance_rules())


def terminal_check(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """A8. The final mark fits the words of the sentence, and there is one."""
    return _sentence_errors(t, rules, ids, terminal_rules())


def sentence_flags(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """A6. One row per sentence: counts, has_verb, the excuses, and whether "no verb" is an error."""
    s = sentence_columns(context(t, ids), rules, ids).where(last_row())
    no_verb = no_verb_rules()[0]
    return s.select(
        *ids, "sent_no", F.col("last_tok").alias("token_count"), "has_verb", "all_light",
        F.col("content_count").cast("int").alias("content_count"),
        (F.col("has_noun") & F.col("has_adjective") & F.col("all_nominal")).alias("is_nominal"),
        no_verb.isNotNull().alias("missing_verb"),
    )


# --- word rules, everything together ------------------------------------------------------------------


def word_rules() -> list[Column]:
    pos, lower = F.col("pos"), F.col("lower")
    known = is_word() & ~F.col("is_proper_noun") & (pos != "FOREIGN")
    return [
        error("UNKNOWN_WORD", is_word() & (pos == "FOREIGN") & ~F.col("is_proper_noun")),
        error("VOWEL_HIATUS", known & (pos != "INTERJECTION") & tx.has_hiatus(lower)),
        error("SPELLING", known & lower.contains("l")),
    ]


def all_rule_columns(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    t = subject_columns(with_role(t), ids)
    return together(t, _context(ids), _purpose(rules, ids), _sentence(rules, ids))


def violations(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS, more: Sequence[Column] = ()) -> DataFrame:
    """Every violation of every rule, and of the rules ``more``, from one pass over the tokens."""
    found = [
        *no_verb_rules(), *agreement_rules(rules), *word_rules(), *subject_verb_rules(), *pair_rule_columns(rules),
        *purpose_rules(), *comma_rule_columns(rules), *clause_punct_rules(rules), *balance_rules(), *terminal_rules(),
        *more,
    ]
    return errors(all_rule_columns(t, rules, ids), found, ids)


# --- W3, W19 ------------------------------------------------------------------------------------------


def resolve_subject(t: DataFrame, rules: RuleTables = RULES, ids: Sequence[str] = IDS) -> DataFrame:
    """W3. Give an ambiguous subject prefix the class of the nearest noun before it that allows it."""
    o = over(ids)

    def nearest(classes: Sequence[int]) -> Column:
        listed = ", ".join(str(c) for c in classes)
        return F.expr(
            f"lag(case when pos = 'NOUN' and noun_class in ({listed}) then noun_class end) ignore nulls {o}"
        )

    s = t.select(
        "*", nearest((1, 4, 6, 9)).alias("_ya"), nearest((4, 9)).alias("_i"), nearest((9, 1)).alias("_y"),
        nearest((3,)).alias("_u"),
    )
    verb, vc, tense = F.col("pos") == "VERB_CONJ", F.col("noun_class"), F.col("verb_tense")
    present = F.coalesce(tense.isin("PRESENT_NORA", "PRESENT"), F.lit(False))
    past = F.coalesce(tense.isin(*rules.past_tenses), F.lit(False))
    resolved = (
        F.when(~F.coalesce(verb, F.lit(False)), vc)
        .when((vc == 6) & past, F.coalesce("_ya", vc))
        .when((vc == 4) & (F.col("_i") == 9), 9)
        .when(vc.isNull() & F.col("lower").startswith("y") & (F.col("_y") == 9), 9)
        .when(vc.isNull() & F.col("lower").startswith("y") & (F.col("_y") == 1) & present, 1)
        .when((vc == 3) & ~F.col("lower").startswith("wa") & F.col("_u").isNull(), None)
        .otherwise(vc)
    )
    return s.select(*[c for c in t.columns if c != "noun_class"], resolved.cast("int").alias("noun_class"))


def numeral_value(word: Column) -> Column:
    """1-9 by ending, tens and hundreds by whole word; null if the word is no numeral."""
    tests = [(word == w, v) for w, v in fixed.NUMERAL_WORDS] + [(word.endswith(e), v) for e, v in fixed.NUMERAL_ENDINGS]
    first = F.when(tests[0][0], tests[0][1])
    return reduce(lambda acc, test: acc.when(test[0], test[1]), tests[1:], first)


def retag(
    t: DataFrame, noun_stems: DataFrame | Sequence[tuple] = tuple(fixed.NOUN_STEMS), rules: RuleTables = RULES,
    ids: Sequence[str] = IDS,
) -> DataFrame:
    """W19. Context passes in their order: elided nouns, numerals, relative nouns, verbal nouns.

    ``noun_stems``: (stem, class) rows in match order, or a table ``lower, stem_class`` with one row per stem.
    """
    t = with_role(t)
    w, o = _window(ids), over(ids)
    columns = t.columns
    dim = bounded(noun_stems.select("lower", "stem_class")) if isinstance(noun_stems, DataFrame) else _stem_table(t, noun_stems)
    t = t.join(dim, "lower", "left")
    stem_class = F.col("stem_class")

    def as_noun(s: DataFrame, when: Column, more: Sequence[str]) -> DataFrame:
        when = F.coalesce(when, F.lit(False))
        changed = {
            "pos": F.lit("NOUN"), "noun_class": stem_class, "verb_tense": F.lit(None), "obj_class": F.lit(None),
            "stem": F.col("lower"),
        }
        return s.select(
            *[
                F.when(when, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c)
                for c in columns
            ],
            "stem_class", *more,
        )

    # demonstrative or relative before a known noun stem of five letters or more. A pronoun can itself be
    # turned only if a pronoun stands before it; then it no longer licenses the next word.
    licence = (F.col("pos") == "PRONOUN") & F.col("pron_type").isin("DEMONSTRATIVE", "RELATIVE")
    can = (F.col("pos") != "NOUN") & is_word() & (F.length("lower") >= 5) & stem_class.isNotNull()
    more = {
        "_row": F.row_number().over(w), "_poss": F.lead(F.col("pron_type") == "POSSESSIVE").over(w),
        "_before": F.expr(f"lag(case when punct_type is null then lower end) ignore nulls {o}"),
    }
    p = _every_other(t, licence, can, w, more)
    t1 = as_noun(p, F.col("_fires"), list(more))
    # place word before a verb, or before a locative that a possessive follows; a word turned into a noun
    # can no longer be the place word of the next one
    place = (F.col("pos") == "LOCATIVE") & rules.has(F.col("lower"), "PLACE")
    can = (F.col("pos") == "VERB_CONJ") | (
        (F.col("pos") == "LOCATIVE") & F.coalesce("_poss", F.lit(False))
    )
    p = _every_other(t1, place, can & stem_class.isNotNull(), w)
    p = as_noun(p, F.col("_fires"), ["_before"])
    # numeral after a tens word
    numeral = (
        is_word() & rules.has(F.col("_before"), "TENS") & numeral_value(F.col("lower")).isNotNull()
        & ~((F.col("pos") == "PRONOUN") & F.coalesce(F.col("pron_type") == "NUMERICAL", F.lit(False)))
    )
    turned = {
        "pos": F.lit("PRONOUN"), "pron_type": F.lit("NUMERICAL"), "noun_class": F.lit(None), "verb_tense": F.lit(None),
        "obj_class": F.lit(None), "stem": F.lit(None),
    }
    numeral = F.coalesce(numeral, F.lit(False))
    t3 = p.select(
        *[F.when(numeral, turned[c]).otherwise(F.col(c)).alias(c) if c in turned else F.col(c) for c in columns]
    )
    # noun + agreeing connector + noun; a noun just turned is no head for the next link, so links of one
    # chain (two tokens apart) fire alternately
    head, conn = "lag(named_struct('pos', pos, 'c', noun_class), 2)", "lag(named_struct('t', pron_type, 'c', noun_class), 1)"
    p = t3.select("*", F.expr(f"{head} {o}").alias("_h"), F.expr(f"{conn} {o}").alias("_c"))
    link = (
        (F.col("_c.t") == "POSSESSIVE")
        & (F.col("_h.pos") == "NOUN")
        & F.col("_h.c").isNotNull()
        & (F.col("pos") == "NOUN")
        & ~F.col("is_proper_noun")
        & (F.col("_c.c").isNull() | (F.col("_c.c") == F.col("_h.c")))
    )
    p = p.withColumn("_link", F.coalesce(link, F.lit(False))).withColumn("_odd", F.col("tok_no") % 2)
    p = _alternate(p, "_link", "tok_no", ids, by="_odd")
    t4 = p.select(
        *[F.when(F.col("_fires"), "RELATIVE_NOUN").otherwise(F.col(c)).alias(c) if c == "pos" else F.col(c) for c in columns]
    )
    # a verb whose object class is taken up by the next pronoun or by a verb within two tokens
    p = t4.select(
        "*",
        F.expr(f"lead(named_struct('pos', pos, 'c', noun_class), 1) {o}").alias("_n1"),
        F.expr(f"lead(named_struct('pos', pos, 'c', noun_class), 2) {o}").alias("_n2"),
        F.collect_set(F.when(F.col("pos") == "NOUN", F.col("noun_class")))
        .over(w.rowsBetween(Window.unboundedPreceding, -1))
        .alias("_nouns"),
    )
    om = F.col("obj_class")

    def is_next(n: str, kind: str) -> Column:
        return F.coalesce((F.col(f"{n}.pos") == kind) & (F.col(f"{n}.c") == om), F.lit(False))

    verbal = (
        (F.col("pos") == "VERB_CONJ")
        & om.isNotNull()
        & (
            is_next("_n1", "PRONOUN")
            | ((is_next("_n1", "VERB_CONJ") | is_next("_n2", "VERB_CONJ")) & ~F.array_contains("_nouns", om))
        )
    )
    verbal = F.coalesce(verbal, F.lit(False))
    role = F.when(verbal, "VERBAL_NOUN").otherwise(F.col("gram_role"))
    return p.select(*[c for c in columns if c != "gram_role"], role.alias("gram_role"))


def _stem_table(t: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    first: dict[str, int] = {}
    for stem, noun_class in rows:
        first.setdefault(stem, noun_class)
    return local_table(t.sparkSession, list(first.items()), "lower string, stem_class int")


def _every_other(s: DataFrame, licence: Column, can: Column, w: Window, more: dict[str, Column] | None = None) -> DataFrame:
    """``_fires``: of a run of rows that can be turned, each after a licence, every other one, starting with the first.

    A row only depends on the one before if that is itself a licence. A run has no gaps, so row numbers tell its places:
    ``more`` are further window columns, ``_row`` among them or there already.
    """
    s = s.select("*", F.coalesce(licence, F.lit(False)).alias("_lic"), F.coalesce(can, F.lit(False)).alias("_can"))
    s = s.select(
        "*", F.lag("_lic", 1).over(w).alias("_l1"), F.lag("_lic", 2).over(w).alias("_l2"), F.lag("_can", 1).over(w).alias("_k1"),
        *[c.alias(n) for n, c in (more or {}).items()],
    )
    on = F.coalesce(F.col("_l1"), F.lit(False)) & F.col("_can")
    depends = F.coalesce(F.col("_l2") & F.col("_k1") & F.col("_l1"), F.lit(False))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    s = s.select("*", on.alias("_on"), (on & ~depends).alias("_begins"))
    s = s.select("*", F.last(F.when(F.col("_begins"), F.col("_row")), True).over(upto).alias("_start"))
    fires = F.col("_on") & ((F.col("_row") - F.col("_start")) % 2 == 0)
    return s.select("*", F.coalesce(fires, F.lit(False)).alias("_fires"))


def _alternate(s: DataFrame, link: str, order: str, ids: Sequence[str], by: str) -> DataFrame:
    """``_fires``: of a run of consecutive links every other one, starting with the first.

    The rows of either value of ``by``, a column of 0 and 1, are a series of their own. All windows are those of the
    sentence, so nothing is sorted again.
    """
    w = Window.partitionBy(*ids, "sent_no").orderBy(order)
    before, upto = (w.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))

    def own(make) -> Column:
        """``make(rows)`` with the rows of the series that the row belongs to."""
        return F.when(F.col(by) == 0, make(F.col(by) == 0)).otherwise(make(F.col(by) == 1))

    on = F.coalesce(F.col(link), F.lit(False))
    s = s.select(
        "*", F.coalesce(own(lambda mine: F.last(F.when(mine, on), True).over(before)), F.lit(False)).alias("_depends"),
        own(lambda mine: F.sum((on & mine).cast("int")).over(upto)).alias("_count"),
    )
    start = on & ~F.col("_depends")
    first = own(lambda mine: F.max(F.when(start & mine, F.col("_count"))).over(upto))
    return s.withColumn("_fires", on & ((F.col("_count") - first) % 2 == 0)).drop("_depends", "_count")


# --- A5 -----------------------------------------------------------------------------------------------


def context_rates(t: DataFrame, words: Sequence[str], ids: Sequence[str] = IDS) -> DataFrame:
    """A5. Per listed word: how often a comma stands before it, and a quote or colon after it."""
    o = over(ids)
    hit = F.col("lower").isin(*words) & is_word()
    c = t.select(
        "lower", "punct_type", "tok_no", F.expr(f"lag(punct_type) {o}").alias("_p"),
        F.expr(f"lead(punct_type) {o}").alias("_n"),
    ).where(hit)
    share = F.avg(F.coalesce(F.col("_p") == "COMMA", F.lit(False)).cast("double"))
    lead = F.avg(F.coalesce(F.col("_n").isin("QUOTE_OPEN", "COLON"), F.lit(False)).cast("double"))
    return c.groupBy(F.col("lower").alias("word")).agg(
        F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("comma_before"), F.round(lead, 6).alias("speech_after")
    )


def place_counts(t: DataFrame, places: Sequence[str], ids: Sequence[str] = IDS) -> DataFrame:
    """A5. Counts of locative form by class of the next word."""
    o = over(ids)
    word = "case when punct_type is null then coalesce(pron_type, pos) end"
    c = t.select("lower", "punct_type", F.expr(f"lead({word}) ignore nulls {o}").alias("next_kind"))
    c = c.where(F.col("lower").isin(*places) & F.col("punct_type").isNull())
    return c.groupBy(F.col("lower").alias("word"), "next_kind").agg(F.count(F.lit(1)).alias("n"))
