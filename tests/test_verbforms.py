"""Generated verb and noun forms against a plain generator, and words of the language."""

import itertools
import re

import pytest

from lexweave.operators import lexicon as lx, paradigms as pg, verbforms as vf
from lexweave.sources import fixed

STEMS = ["kor", "andik", "mesh", "ic", "it", "giy", "b", "tsind", "pfund", "han", "uz", "o"]


def contact(prefix, rest):
    """Two parts of a verb written together."""
    if not prefix:
        return rest
    if prefix == "n":
        for start, new in (("pf", "mf"), ("ts", "ns"), ("b", "mb"), ("f", "mf"), ("p", "mp"), ("v", "mv"), ("h", "mp"), ("r", "nd"), ("m", "m"), ("n", "n"), ("c", "nsh")):
            if rest.startswith(start):
                return new + rest[len(start) :]
        return "n" + rest
    vowels, before = "aeiou", prefix[-2:-1] if len(prefix) > 1 else ""
    if prefix[-1] not in vowels or not rest or rest[0] not in vowels:
        return prefix + rest
    body = prefix[:-1]
    if prefix[-1] == "u":
        return body + ("" if before in ("k", "g", "h") and rest[0] in "ou" else "w") + rest
    if prefix[-1] == "i":
        if before == "k":
            return body[:-1] + ("k" if rest[0] in "ie" else "cy") + rest
        return body[:-1] + "g" + rest if before == "j" and rest[0] == "e" else body + "y" + rest
    return body + "e" + rest[1:] if rest[0] == "i" and before not in ("y", "w") else body + rest


def with_past(stem, ext):
    out = "|".join(x for x in (stem, ext, "ye") if x)
    for when, pattern, new, times in fixed.SEAM_RULES:
        if r"\|y" in pattern and when != "9":
            for _ in range(times):
                out = re.sub(pattern, new.replace("$", "\\"), out)
    return out.replace("|", "")


def all_forms(stems, extensions):
    subjects = [(p, c) for p, c in fixed.SUBJECT_PREFIXES if p not in fixed.CONTACT_PREFIXES]
    objects = [("", None)] + [(f, c) for f, _, c in fixed.OBJECT_MARKERS]
    out = set()
    for stem, (ext, name), (final, written, needs) in itertools.product(stems, [("", None), *extensions], fixed.FINAL_FORMS):
        if needs and not re.search(needs, stem + ext):
            continue
        core = with_past(stem, ext) if written == "ye" else stem + ext + written
        for (plain, marker, f2, placed, only), place, (o, oc), (p, c) in itertools.product(fixed.TENSE_SLOTS, ["", *fixed.PLACE_SUFFIXES], objects, subjects):
            late = p in fixed.PAST_ONLY_PREFIXES
            if f2 != final or (place and not placed) or (only == "past" and not late) or (only == "!past" and late):
                continue
            surface = contact(p, contact(marker, contact(o, core + place)))
            slots = "|".join(x for x in (p, marker, o, stem, ext, final, place) if x)
            out.add((surface, p, c, marker, o, oc, stem, name, final, place, placed if place else plain, slots))
    return out


def test_forms_written_out(spark):
    stems = spark.createDataFrame([(s,) for s in STEMS], "stem string")
    extensions = [("ir", "APPLICATIVE"), ("w", "PASSIVE")]
    got = {tuple(r) for r in vf.expand(stems, extensions).select("surface", *vf.PARSE).collect()}
    assert got == all_forms(STEMS, extensions)


def test_words_are_read_as_every_form_that_they_are(spark):
    """Cutting a word finds what writing all forms out finds: nothing is missed, nothing else is found."""
    extensions = [("ir", "APPLICATIVE"), ("w", "PASSIVE")]
    wanted = {}
    for surface, *parse in all_forms(STEMS, extensions):
        wanted.setdefault(surface, set()).add(tuple(parse))
    words = sorted(w for w in wanted if len(w) > 2 and not re.match("nt[aiu].|si..", w))[::7] + ["nothing", "ba", "xyz"]
    stems = spark.createDataFrame([(s,) for s in [*STEMS, "kor", ""]], "stem string")
    rows = vf.analyses(spark.createDataFrame([(w,) for w in words], "word string"), stems, extensions).collect()
    found = {}
    for r in rows:
        found.setdefault(r["word"], {})[r["rank"]] = tuple(r[3:])
        assert not r["is_negative"]
    assert {w: set(x.values()) for w, x in found.items()} == {w: wanted[w] for w in words if w in wanted}
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in found.values())


KNOWN = "kor gend vug mesh andik bon tangir tang men meny ic ish it sam tek rem ig shumbush baz".split()


@pytest.mark.parametrize(
    ("word", "stem", "tense"),
    [
        ("yakoze", "kor", "PAST_PERF"), ("twagenze", "gend", "PAST_PERF"), ("yavuze", "vug", "PAST_PERF"),
        ("yameshe", "mesh", "PAST_PERF"), ("banditse", "andik", "PAST_PERF"), ("murakoze", "kor", "PAST_PERF"),
        ("batangiye", "tangir", "PAST_PERF"), ("imenye", "meny", "SUBJUNCTIVE"), ("bamenye", "meny", "PAST_PERF"),
        ("yamwishe", "ic", "PAST_PERF"), ("nishe", "ic", "PAST_PERF"), ("yise", "it", "PAST_PERF"), ("yize", "ig", "PAST_PERF"),
        ("basamuye", "sam", "PAST_PERF"), ("bazuye", None, None), ("yashumbushije", "shumbush", "PAST_PERF"),
        ("byatetswe", "tek", "PAST_PERF"), ("yaremye", "rem", "PAST_PERF"), ("yagendaga", "gend", "PAST_IMPF"),
        ("azagenda", "gend", "FUTURE"), ("agende", "gend", "SUBJUNCTIVE"), ("akagenda", "gend", "NARRATIVE"),
        ("mbona", "bon", "PRESENT_NORA"), ("ndagenda", "gend", "PRESENT"), ("turamubona", "bon", "PRESENT"),
        ("ntarakora", "kor", "PRESENT"), ("arakoreraho", "kor", "PRESENT"),
    ],
)
def test_words_of_the_language(parsed, word, stem, tense):
    row = parsed.get(word)
    if stem is None:
        assert row is None or not row.stem_known
    else:
        assert (row.stem, row.tense, row.stem_known) == (stem, tense, True)


@pytest.fixture(scope="module")
def parsed(spark):
    words = [p.values[0] if hasattr(p, "values") else p[0] for p in test_words_of_the_language.pytestmark[0].args[1]]
    out = lx.verbs(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(s,) for s in KNOWN], "stem string"))
    return {r.word: r for r in out.collect()}


def test_negative_and_objects(spark):
    out = {r.word: r for r in lx.verbs(spark.createDataFrame([("ntarakora",), ("turamubona",), ("byatetswe",), ("mwikora",)], "word string"), spark.createDataFrame([(s,) for s in KNOWN], "stem string")).collect()}
    assert out["ntarakora"].is_negative and out["turamubona"].obj_class == 1 and out["byatetswe"].ext == "PASSIVE"
    assert out["mwikora"].tense == "NEG_IMPERATIVE"


def test_noun_forms(spark):
    stems = spark.createDataFrame([("yira", 9), ("gabo", 1), ("ana", 1), ("tabo", 7), ("vura", 9), ("go", 11), ("zu", 9)], "stem string, noun_class int")
    got = {(r.stem, r.number): r.surface for r in pg.expand_nouns(stems).collect()}
    assert got["yira", "singular"] == "inzira" and got["vura", "singular"] == "imvura"
    assert got["gabo", "singular"] == "umugabo" and got["gabo", "plural"] == "abagabo"
    assert got["ana", "singular"] == "umwana" and got["go", "singular"] == "urugo"
    words = spark.createDataFrame([("inzira",), ("umugabo",), ("x",)], "word string")
    assert {(r.word, r.stem, r.form_class) for r in pg.noun_forms(words, stems).collect()} == {("inzira", "yira", 9), ("inzira", "yira", 10), ("umugabo", "gabo", 1)}
