"""Fixed values of the language (ISO 639-1 ``rw``): tables that must be as they are for right results.

Everything here is data, in its natural order; the order is the match order. Large open word lists (verb
stems, invariable words, known words, pronouns, verb glosses) are not kept here: they are read from a
lexicon folder given by the user, see ``dimensions.load_dimensions``.
"""

# Noun classes (number, prefix, class marker, adjective concord, connector, subject prefix).
NOUN_CLASSES = [
    (1, "umu", "mu", "mu", "wa", "a"),
    (2, "aba", "ba", "ba", "ba", "ba"),
    (3, "umu", "mu", "mu", "wa", "u"),
    (4, "imi", "mi", "mi", "ya", "i"),
    (5, "i", "ri", "ri", "rya", "ri"),
    (6, "ama", "ma", "ma", "ya", "a"),
    (7, "iki", "ki", "ki", "cya", "ki"),
    (8, "ibi", "bi", "bi", "bya", "bi"),
    (9, "in", "n", "n", "ya", "i"),
    (10, "in", "n", "zi", "za", "zi"),
    (11, "uru", "ru", "ru", "rwa", "ru"),
    (12, "aka", "ka", "ka", "ka", "ka"),
    (13, "utu", "tu", "tu", "twa", "tu"),
    (14, "ubu", "bu", "bu", "bwa", "bu"),
    (15, "uku", "ku", "ku", "kwa", "ku"),
    (16, "aha", "ha", "ha", "ha", "ha"),
]

# Singular classes and the class of their plural.
PLURAL_CLASSES = [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 10), (12, 13), (14, 6)]

# Elided connectors and the class they stand for.
ELIDED_CONNECTORS = [
    ("rw", 11), ("bw", 14), ("cy", 7), ("ry", 5), ("by", 8), ("tw", 13), ("y", 9), ("w", 1), ("b", 2),
]

# Connectors that lose their final vowel before a vowel.
ELISION = [
    ("ya", "y'"), ("wa", "w'"), ("ba", "b'"), ("rya", "ry'"), ("cya", "cy'"), ("bya", "by'"), ("za", "z'"),
    ("rwa", "rw'"), ("twa", "tw'"), ("bwa", "bw'"), ("kwa", "kw'"), ("hwa", "hw'"), ("na", "n'"), ("nka", "nk'"),
]

# Word classes of the rules, as (word, class).
RULE_WORDS = [
    ("ariko", "ADVERSATIVE"), ("naho", "ADVERSATIVE"), ("cyakora", "ADVERSATIVE"), ("icyakora", "ADVERSATIVE"),
    ("ahubwo", "ADVERSATIVE"), ("nyamara", "ADVERSATIVE"),
    ("kandi", "COORDINATOR"), ("cyangwa", "COORDINATOR"), ("ndetse", "COORDINATOR"),
    ("maze", "SEQUENTIAL"), ("kuko", "SEQUENTIAL"),
    ("bikurikira", "LIST_PREDICATE"), ("akurikira", "LIST_PREDICATE"), ("zikurikira", "LIST_PREDICATE"),
    ("ikurikira", "LIST_PREDICATE"), ("bikurikiraho", "LIST_PREDICATE"), ("ikurikiraho", "LIST_PREDICATE"),
    ("zikurikiraho", "LIST_PREDICATE"),
    ("ati", "SPEECH"), ("bati", "SPEECH"), ("uti", "SPEECH"), ("nti", "SPEECH"), ("iti", "SPEECH"),
    ("riti", "SPEECH"), ("muti", "SPEECH"), ("tuti", "SPEECH"), ("ziti", "SPEECH"), ("kiti", "SPEECH"),
    ("hati", "SPEECH"), ("kuti", "SPEECH"), ("ngo", "SPEECH"),
    ("nde", "INTERROGATIVE"), ("iki", "INTERROGATIVE"), ("ryari", "INTERROGATIVE"), ("he", "INTERROGATIVE"),
    ("hehe", "INTERROGATIVE"), ("gute", "INTERROGATIVE"), ("kangahe", "INTERROGATIVE"), ("kuki", "INTERROGATIVE"),
    ("ikihe", "INTERROGATIVE"), ("harya", "INTERROGATIVE"), ("mbese", "INTERROGATIVE"), ("ese", "INTERROGATIVE"),
    ("erega", "EXCLAMATIVE"), ("ayii", "EXCLAMATIVE"), ("ishyano", "EXCLAMATIVE"), ("mbega", "EXCLAMATIVE"),
    ("iyaba", "EXCLAMATIVE"), ("ntibikabeho", "EXCLAMATIVE"), ("ntibikambeho", "EXCLAMATIVE"),
    ("haleluya", "EXCLAMATIVE"), ("nimwumve", "EXCLAMATIVE"), ("yemwe", "EXCLAMATIVE"), ("nkanswe", "EXCLAMATIVE"),
    ("ko", "INITIAL_EXCLAMATIVE"),
    ("ni", "COPULA"), ("si", "COPULA"),
    ("niba", "CONDITIONAL"), ("iyo", "INITIAL_CONDITIONAL"),
    ("ngo", "PURPOSE"),
    ("ngo", "COMPLEMENT"), ("ko", "COMPLEMENT"), ("kuti", "COMPLEMENT"),
    ("mirongo", "TENS"), ("magana", "TENS"),
    ("mu", "PLACE"), ("ku", "PLACE"), ("i", "PLACE"), ("kuri", "PLACE"), ("muri", "PLACE"), ("kwa", "PLACE"),
    ("ava", "PLACE"), ("kuva", "PLACE"),
]

# Forms of "have" that are sometimes written together with the next word.
FUSED_FORMS = [
    "bafite", "bifite", "zifite", "rufite", "gafite", "dufite", "mufite", "bufite", "gifite", "nfite", "ufite",
    "afite", "ifite",
]

# Adjective stems.
ADJ_STEMS = [
    "nini", "inshi", "bi", "tindi", "gari", "iza", "sa", "sa-sa", "zima", "to", "toto", "to-to", "toya", "ke",
    "keya", "ke-ke", "kuru", "bisi", "shya", "shyashya", "gufi", "gufiya", "re", "re-re", "tagatifu", "hire",
    "taraga", "nzinya", "nzunyu", "nuya", "niniya", "nzuzunya", "nunuya", "niniriya", "nziginya", "nzugurunyu",
    "nzima", "ogo", "eru", "rimbwa", "nkuru", "meze",
]

# Adjective prefixes and their class, in match order.
ADJ_PREFIXES = [
    ("mu", 1), ("ba", 2), ("mu", 3), ("mi", 4), ("ri", 5), ("ma", 6), ("ki", 7), ("bi", 8), ("n", 9), ("zi", 10),
    ("ru", 11), ("ka", 12), ("tu", 13), ("bu", 14), ("ku", 15), ("ha", 16), ("mw", 1), ("rw", 11), ("bw", 14),
    ("kw", 15), ("tw", 13), ("by", 8), ("cy", 7), ("my", 4), ("ry", 5), ("m", 9), ("nd", 9), ("nz", 9), ("ga", 12),
    ("be", 2), ("me", 6), ("ye", 4), ("ze", 10), ("he", 16), ("h", 16),
]
# Letter the stem lost at the seam, by adjective prefix.
ADJ_RESTORED = [("n", "n"), ("nd", "r"), ("be", "i"), ("me", "i"), ("ye", "i"), ("ze", "i"), ("he", "i")]

# Object markers (before a consonant, before a vowel, class), in match order.
OBJECT_MARKERS = [
    ("mu", "mw", 1), ("ki", "cy", 7), ("bi", "by", 8), ("bu", "bw", 14), ("ba", "ba", 2), ("u", "wu", 3),
    ("yi", "yi", 4), ("ri", "ry", 5), ("ya", "ya", 6), ("zi", "zi", 10), ("ru", "rw", 11), ("ka", "ka", 12),
    ("tu", "tw", 13), ("ku", "kw", 15), ("ha", "ha", 16),
]

# Subject prefixes and their class (0 = a person, no class), in match order.
SUBJECT_PREFIXES = [
    ("twa", 0), ("mwa", 0), ("rwa", 11), ("bwa", 14), ("kwa", 15), ("ara", 1), ("nda", 0), ("ndi", 0), ("ba", 2),
    ("bw", 14), ("rw", 11), ("tw", 0), ("mw", 0), ("cya", 7), ("bya", 8), ("rya", 5), ("zya", 10), ("cy", 7),
    ("by", 8), ("biy", 8), ("ry", 5), ("zy", 10), ("zu", 10), ("mb", 0), ("mp", 0), ("mf", 0), ("mv", 0),
    ("du", 0), ("na", 0), ("wa", 3), ("ya", 6), ("za", 10), ("tu", 0), ("mu", 0), ("ri", 5), ("ki", 7), ("gi", 7),
    ("bi", 8), ("zi", 10), ("ru", 11), ("ka", 12), ("ga", 12), ("bu", 14), ("ku", 15), ("ha", 16), ("hu", 16),
    ("hi", 16), ("u", 3), ("i", 4), ("a", 1), ("nu", 0), ("n", 0), ("w", 3), ("y", 0), ("b", 2),
]
PAST_PREFIXES = ["twa", "ya", "wa", "na", "bya", "cya", "rya", "zya", "bwa", "kwa", "rwa", "mwa", "za"]
PAST_ONLY_PREFIXES = ["twa", "bya", "cya", "rya", "rwa", "zya", "bwa", "kwa", "mwa"]

# Tense patterns on what follows the subject prefix, in match order. The group is the stem.
# Stem test: "" any; "known" in the stem list; "known1" one-letter stems must be in the list;
# "two" at least two letters; "last" in the list, or else the fallback of the whole word.
# Prefixes: "" any; "ara", "u", "past", "pastonly" only those; "!ka" any but ka (and ga).
TENSE_PATTERNS = [
    ("PRESENT", "ara", "^(.{2,})a(?:ho|mo|yo)$", ""),
    ("PRESENT", "ara", "^(.+)a$", ""),
    ("FUTURE", "!ara", "^za(.+)a$", "known1"),
    ("FUTURE", "!ara", "^za(.+)a(?:ho|mo|yo)$", ""),
    ("FUTURE_SUBJ", "!ara", "^za(.+)e$", ""),
    ("FUTURE_SUBJ_LOC", "!ara", "^za(.+)e(?:ho|mo|yo)$", ""),
    ("NARRATIVE_SUBJ", "!ka", "^ka(.+)e$", "known"),
    ("NARRATIVE", "!ka", "^ka(.+)a$", "known"),
    ("NARRATIVE", "!ka", "^ga(.{2,})a$", "known"),
    ("OPTATIVE", "!ara", "^raka(.{2,})a$", ""),
    ("PRESENT", "!ara", "^ra(.+)[ao]$", ""),
    ("PRESENT", "!ara", "^r([aeiou].+)a$", "known"),
    ("PAST_IMPF", "!ara", "^(.+)aga$", ""),
    ("PAST_PERF", "!ara", "^(.+[^aeiou])iye$", "known"),
    ("PAST_PERF", "!ara", "^(.{2,})ye$", ""),
    ("PAST_PERF", "!ara", "^(.{2,})tse$", ""),
    ("PAST_PERF_LOC", "past", "^(.{2,})e(?:ho|mo|yo)$", ""),
    ("SUBJUNCTIVE_LOC", "!ara", "^(.+)e(?:ho|mo|yo)$", "known1"),
    ("SUBJUNCTIVE", "!ara", "^(.+)e$", ""),
    ("COPULA_PAST", "past", "^(ri)(?:ho|mo|yo)?$", ""),
    ("COPULA_PRES", "!ara", "^(ri)(?:ho|mo|yo)?$", ""),
    ("NEG_ANTERIOR", "!ara", "^tara(.+)a$", ""),
    ("NEG_RELATIVE", "!ara", "^ta(.{2,})a$", ""),
    ("NEG_DA_2SG", "u", "^da(.{2,})a$", ""),
    ("CONDITIONAL", "past", "^[kg]u(.{2,})a$", ""),
    ("CONDITIONAL", "pastonly", "^(.{2,})a$", ""),
    ("PRESENT_NORA", "!ara", "^(.+)a(?:ho|mo|yo)$", "known1"),
    ("PRESENT_NORA", "!ara", "^(.+)[ao]$", "last"),
]

# Subject prefixes that only arise from contact with what follows; forms are generated from the others.
CONTACT_PREFIXES = [
    "ara", "nda", "ndi", "bw", "rw", "tw", "mw", "cy", "by", "biy", "ry", "zy", "zu", "mb", "mp", "mf", "mv", "w", "y", "b",
]

# Prefixes after which a stem in y with final e is a past perfect, not a subjunctive.
Y_PAST_PREFIXES = [
    "twa", "ya", "wa", "na", "bya", "cya", "rya", "zya", "bwa", "kwa", "rwa", "mwa", "za", "ba", "mu", "tu", "a", "ni", "ri", "zi",
    "bi", "ki", "ru", "ka", "bu", "ku", "ha",
]

# Tenses as slots, in order of preference: tense, marker, final, tense with a place suffix ("" none),
# prefixes ("past" only the past ones, "!past" all others).
TENSE_SLOTS = [
    ("PRESENT", "ra", "a", "PRESENT", ""),
    ("FUTURE", "za", "a", "FUTURE", ""),
    ("FUTURE_SUBJ", "za", "e", "FUTURE_SUBJ_LOC", ""),
    ("NARRATIVE_SUBJ", "ka", "e", "", ""),
    ("NARRATIVE", "ka", "a", "", ""),
    ("NARRATIVE", "ga", "a", "", ""),
    ("OPTATIVE", "raka", "a", "", ""),
    ("PAST_IMPF", "", "aga", "", ""),
    ("PAST_PERF", "", "ye", "PAST_PERF_LOC", ""),
    ("PAST_PERF", "ra", "ye", "", ""),
    ("SUBJUNCTIVE", "", "e", "SUBJUNCTIVE_LOC", "!past"),
    ("NEG_ANTERIOR", "tara", "a", "", ""),
    ("NEG_RELATIVE", "ta", "a", "", ""),
    ("CONDITIONAL", "", "a", "", "past"),
    ("PRESENT_NORA", "", "a", "PRESENT_NORA", "!past"),
]
# How a final is written after the stem, by the stem's end; "ye" itself fuses with it (seam rules).
FINAL_FORMS = [
    ("a", "a", ""), ("e", "e", ""), ("aga", "aga", ""), ("ye", "ye", ""), ("ye", "iye", "[^aeiou]$"),
    ("ye", "uye", "[^aeiouz]$"), ("ye", "ije", "sh$"),
]
PLACE_SUFFIXES = ["ho", "mo", "yo"]

# Verb extensions, in match order (ending, name).
EXTENSIONS = [
    ("ish", "CAUSATIVE"), ("esh", "CAUSATIVE"), ("ir", "APPLICATIVE"), ("er", "APPLICATIVE"), ("ey", "APPLICATIVE"),
    ("ik", "STATIVE"), ("ek", "STATIVE"), ("ur", "REVERSIVE"), ("uk", "REVERSIVE"), ("an", "RECIPROCAL"),
    ("ejw", "PASSIVE"), ("ijw", "PASSIVE"), ("w", "PASSIVE"),
]

# Noun prefixes in match order: prefix, class, shortest word, letter after ("V" vowel,
# "C" other), last letter ("N" not a or e), letters to strip before the stem.
NOUN_PREFIXES = [
    ("umu", 1, 5, "", "", 3), ("aba", 2, 5, "", "", 3), ("imi", 4, 5, "", "", 3), ("imy", 4, 5, "", "", 3),
    ("ama", 6, 5, "", "", 3), ("am", 6, 5, "V", "", 2), ("iki", 7, 5, "", "", 3), ("igi", 7, 5, "", "", 3),
    ("ibi", 8, 5, "", "", 3), ("iby", 8, 5, "", "", 3), ("uru", 11, 5, "", "", 3), ("aka", 12, 5, "", "", 3),
    ("aga", 12, 5, "", "", 3), ("utu", 13, 5, "", "", 3), ("utw", 13, 5, "", "", 3), ("ubu", 14, 5, "", "", 3),
    ("uku", 15, 5, "", "", 3), ("ukw", 15, 5, "", "", 3), ("aha", 16, 5, "", "", 3), ("ubw", 14, 5, "", "", 3),
    ("urw", 11, 5, "", "", 3), ("iri", 5, 5, "", "", 3), ("in", 9, 4, "", "", 1), ("im", 9, 4, "", "", 1),
    ("icy", 7, 5, "", "", 3), ("i", 5, 4, "C", "", 1), ("gi", 7, 4, "C", "", 2), ("bi", 8, 5, "C", "N", 2),
    ("ki", 7, 5, "C", "N", 2), ("ri", 5, 5, "C", "N", 2), ("mi", 4, 5, "C", "", 2), ("ma", 6, 4, "C", "", 2),
    ("ka", 12, 5, "C", "N", 2), ("ga", 12, 4, "C", "N", 2), ("my", 4, 5, "", "", 1), ("mu", 1, 5, "C", "", 2),
    ("bu", 14, 5, "C", "", 2), ("bw", 14, 5, "", "", 2), ("ru", 11, 5, "C", "N", 2), ("ba", 2, 6, "C", "N", 2),
    ("umw", 1, 5, "", "", 3), ("mw", 1, 4, "", "", 2), ("ab", 2, 5, "V", "", 1), ("by", 8, 5, "V", "", 2),
    ("cy", 7, 5, "V", "", 2), ("rw", 11, 5, "V", "", 2), ("ry", 5, 5, "V", "", 2), ("tw", 13, 5, "V", "", 2),
    ("wu", 3, 6, "C", "N", 1), ("yi", 4, 6, "C", "N", 1),
]

# Noun stems and their class; the first of equal stems counts.
NOUN_STEMS = [
    ("nt", 1), ("kobwa", 1), ("hungu", 1), ("gore", 1), ("gabo", 1), ("nyeshuri", 1), ("rimu", 1), ("rimyi", 1),
    ("bwirwa", 1), ("ti", 3), ("go", 3), ("ezi", 3), ("ka", 3), ("ye", 5), ("zi", 5), ("hore", 5), ("shuri", 5),
    ("gi", 6), ("tara", 5), ("tabo", 7), ("go", 7), ("baho", 11), ("go", 11), ("zi", 14), ("mero", 14),
    ("enge", 14), ("ntu", 16), ("juru", 5), ("si", 9), ("mana", 9), ("cyo", 7), ("kize", 7), ("kiza", 7),
    ("wijima", 9), ("hengeri", 9), ("sanzure", 5), ("nyanja", 9), ("butaka", 14), ("atsi", 14), ("miro", 4),
    ("ko", 12), ("gibo", 14), ("bi", 9), ("munsi", 3),
]

# Nouns that look like verb derivations but are not.
PRIMARY_NOUN_STEMS = ["siga", "gore", "gabo", "taka", "tungo", "hungu", "kuru", "ryo", "nywa"]

# Singular, plural, stem, singular class, plural class.
PLURAL_PAIRS = [
    ("umuntu", "abantu", "ntu", 1, 2), ("umugabo", "abagabo", "gabo", 1, 2), ("umugore", "abagore", "gore", 1, 2),
    ("umwana", "abana", "ana", 1, 2), ("umuhungu", "abahungu", "hungu", 1, 2),
    ("umukobwa", "abakobwa", "kobwa", 1, 2), ("umunyeshuri", "abanyeshuri", "nyeshuri", 1, 2),
    ("umurimyi", "abarimyi", "rimyi", 1, 2), ("umubyeyi", "ababyeyi", "byeyi", 1, 2),
    ("umutegetsi", "abategetsi", "tegetsi", 1, 2), ("umutunzi", "abatunzi", "tunzi", 1, 2),
    ("umugenzi", "abagenzi", "genzi", 1, 2), ("umukuru", "abakuru", "kuru", 1, 2),
    ("umusaza", "abasaza", "saza", 1, 2), ("umugaragu", "abagaragu", "garagu", 1, 2),
    ("umwami", "abami", "mi", 1, 2), ("umwigisha", "abigisha", "igisha", 1, 2),
    ("umuti", "imiti", "ti", 3, 4), ("umugezi", "imigezi", "gezi", 3, 4), ("umugozi", "imigozi", "gozi", 3, 4),
    ("umuriro", "imiriro", "riro", 3, 4), ("umunsi", "iminsi", "nsi", 3, 4),
    ("umuryango", "imiryango", "ryango", 3, 4), ("umusozi", "imisozi", "sozi", 3, 4),
    ("umudugudu", "imidugudu", "dugudu", 3, 4), ("umurimo", "imirimo", "rimo", 3, 4),
    ("umutima", "imitima", "tima", 3, 4), ("umurongo", "imirongo", "rongo", 3, 4),
    ("iryinyo", None, "inyo", 5, 0), ("amenyo", None, "inyo", 6, 0), ("itungo", "amatungo", "tungo", 5, 6),
    ("itegeko", "amategeko", "tegeko", 5, 6), ("izina", "amazina", "zina", 5, 6), ("itara", "amatara", "tara", 5, 6),
    ("ibuye", "amabuye", "buye", 5, 6), ("isoko", "amasoko", "soko", 5, 6), ("isomo", "amasomo", "somo", 5, 6),
    ("igitabo", "ibitabo", "tabo", 7, 8), ("igisiga", "ibisiga", "siga", 7, 8), ("ikigo", "ibigo", "go", 7, 8),
    ("ikintu", "ibintu", "ntu", 7, 8), ("igihe", "ibihe", "he", 7, 8), ("igihugu", "ibihugu", "hugu", 7, 8),
    ("inka", None, "ka", 9, 10), ("inkoko", None, "koko", 9, 10), ("inzu", None, "zu", 9, 10),
    ("imvura", None, "vura", 9, 10), ("imana", None, "mana", 9, 10), ("inyoni", None, "nyoni", 9, 10),
    ("inzira", None, "yira", 9, 10), ("inzara", None, "yara", 9, 10), ("inzoga", None, "yoga", 9, 10),
    ("inzoka", None, "yoka", 9, 10), ("urugo", None, "go", 11, 0), ("urukundo", None, "kundo", 11, 0),
    ("urugendo", None, "gendo", 11, 0), ("akagabo", "utugabo", "gabo", 12, 13),
    ("akarima", "uturima", "rima", 12, 13), ("akazi", "uduzi", "zi", 12, 13), ("ubutaka", None, "taka", 14, 0),
    ("ubutunzi", None, "tunzi", 14, 0), ("ubuzima", None, "zima", 14, 0), ("ubwenge", None, "enge", 14, 0),
    ("ubwami", None, "ami", 14, 0), ("uburezi", None, "rezi", 14, 0), ("ubwoko", "amoko", "oko", 14, 6),
    ("ukwezi", None, "ezi", 15, 0), ("ahantu", None, "ntu", 16, 0),
]

# Spelling rules (id, type, letters, where): "start" the word begins with i before them,
# "o" the word has an o and a consonant stands before, "first" one report per word.
VOWEL_PAIRS = [a + b for a in "aeiou" for b in "aeiou"]
ORTHO_RULES = [("1.1/2.1", "VV_HIATUS", pair, "") for pair in VOWEL_PAIRS] + [
    ("3.3.1", "NASAL_ASSIM", "nf", ""),
    ("3.3.2", "NASAL_ASSIM", "np", ""),
    ("3.3.3", "NASAL_ASSIM", "nb", ""),
    ("3.3.4", "NASAL_ASSIM", "nh", ""),
    ("3.3.5", "NASAL_ASSIM", "nv", ""),
    ("3.1", "NASAL_ELISION", "nm", "start"),
    ("3.1", "NASAL_ELISION", "nn", "start"),
    ("3.9.1", "CY_UNFUSED", "dy", ""),
    ("3.9.2", "CY_UNFUSED", "gy", ""),
    ("3.9.6", "CY_UNFUSED", "sy", ""),
    ("3.9.11", "CY_UNFUSED", "zy", ""),
    ("3.9.7", "CY_UNFUSED", "ky", ""),
    ("3.9.10", "CY_UNFUSED", "ty", ""),
    ("3.6.1", "STOP_UNDELETED", "nts", ""),
    ("3.6.2", "C_NOT_SH", "nc", ""),
    ("3.6.3", "STOP_UNDELETED", "mpf", ""),
    ("1.3.1", "VOWEL_ASSIM", "ir", "o"),
    ("1.3.1", "VOWEL_ASSIM", "ish", "o"),
    ("2.3", "LETTER_L", "l", "first"),
]

# Graphemes with their phoneme and IPA, longest first.
PHONEMES = [
    ("nsh", "nsh", "nʃ"), ("nzw", "nzw", "nzʷ"), ("ngw", "ngw", "ŋɡʷ"), ("shw", "shw", "ʃʷ"),
    ("sh", "sh", "ʃ"), ("ny", "ny", "ɲ"), ("ts", "ts", "ts"), ("mb", "mb", "mb"), ("mf", "mf", "mf"),
    ("mp", "mp", "mp"), ("mv", "mv", "mv"), ("nd", "nd", "nd"), ("ng", "ng", "ŋɡ"), ("nj", "nj", "ndʒ"),
    ("nk", "nk", "ŋk"), ("nt", "nt", "nt"), ("nz", "nz", "nz"), ("bw", "bw", "bʷ"), ("cw", "chw", "tʃʷ"),
    ("dw", "dw", "dʷ"), ("fw", "fw", "fʷ"), ("gw", "gw", "ɡʷ"), ("hw", "hw", "hʷ"), ("kw", "kw", "kʷ"),
    ("mw", "mw", "mʷ"), ("nw", "nw", "nʷ"), ("pw", "pw", "pʷ"), ("rw", "rw", "ɾʷ"), ("sw", "sw", "sʷ"),
    ("tw", "tw", "tʷ"), ("vw", "vw", "vʷ"), ("yw", "yw", "jʷ"), ("zw", "zw", "zʷ"),
    ("a", "a", "a"), ("b", "b", "b"), ("c", "ch", "tʃ"), ("d", "d", "d"), ("e", "e", "e"), ("f", "f", "f"),
    ("g", "g", "ɡ"), ("h", "h", "h"), ("i", "i", "i"), ("j", "j", "dʒ"), ("k", "k", "k"), ("l", "l", "l"),
    ("m", "m", "m"), ("n", "n", "n"), ("o", "o", "o"), ("p", "p", "p"), ("r", "r", "ɾ"), ("s", "s", "s"),
    ("t", "t", "t"), ("u", "u", "u"), ("v", "v", "v"), ("w", "w", "w"), ("y", "y", "j"), ("z", "z", "z"),
]

# Number words and abbreviations.
UNITS = ["zeru", "rimwe", "kabiri", "gatatu", "kane", "gatanu", "gatandatu", "karindwi", "umunani", "icyenda"]
TENS = [
    "", "icumi", "makumyabiri", "mirongo itatu", "mirongo ine", "mirongo itanu", "mirongo itandatu",
    "mirongo irindwi", "mirongo inani", "mirongo icyenda",
]
ABBREVIATIONS = [
    ("km", "kilometero"), ("kg", "kilogiramu"), ("cm", "santimetero"), ("mm", "milimetero"), ("mg", "miligiramu"),
    ("dl", "desilite"), ("ml", "mililitre"), ("nr", "nomero"), ("no", "nomero"), ("frw", "amafaranga"),
    ("rwf", "amafaranga"), ("usd", "amadolari"), ("dr", "dogiteri"), ("prof", "profeseri"),
]

# Numerals as whole words, then by ending; "tandatu" stands before "tatu".
NUMERAL_WORDS = [
    ("icumi", 10), ("makumyabiri", 20), ("ijana", 100), ("maganabiri", 200), ("igihumbi", 1000), ("ibihumbi", 1000),
    ("mirongo", 10), ("magana", 100),
]
NUMERAL_ENDINGS = [
    ("mwe", 1), ("biri", 2), ("tandatu", 6), ("tatu", 3), ("tanu", 5), ("rindwi", 7), ("nani", 8), ("yenda", 9),
    ("wenda", 9), ("enye", 4), ("ne", 4),
]

# Prefixes a stem is split from, longest first.
SPLIT_PREFIXES = [
    "umu", "umw", "aba", "abw", "imi", "imy", "iki", "icy", "ibi", "iby", "ama", "amw", "uru", "urw", "aka", "akw",
    "utu", "utw", "ubu", "ubw", "uku", "ukw", "aha", "ab", "am", "in", "im", "ku", "kw", "gu", "i",
]

# Connectives that change the melody of the next word.
CONNECTIVES = [
    "na", "nka", "wa", "ya", "ba", "za", "cya", "bya", "rya", "ka", "twa", "bwa", "kwa", "ha", "rwa", "gwa", "ga",
    "mwa", "ra", "y'", "w'",
]

# Spelling at morpheme seams, applied in this order to a "|"-delimited form.
# (when, pattern, replacement, times): "9" holds only for noun class 9, "!9" only for other forms.
SEAM_RULES = [
    ("", r"\|w\|y", "|y|w", 1),
    ("", r"sh\|y", "sh", 2),
    ("", r"j\|y", "j", 2),
    ("", r"[dg]\|y", "z", 2),
    ("", r"([ie])r\|y", "$1y", 2),
    ("", r"r\|y", "z", 2),
    ("", r"s\|y", "sh", 2),
    ("", r"nk\|y", "ns", 2),
    ("", r"k\|y", "ts", 2),
    ("", r"c\|y([aeiou])", "sh$1", 2),
    ("", r"c\|y", "c", 2),
    ("", r"at\|y([aeiou])", "ash$1", 2),
    ("", r"t\|y", "s", 2),
    ("", r"z\|y", "j", 2),
    ("", r"h\|y", "sh", 2),
    ("!9", r"(^|[^n])n\|y", "$1nny", 2),
    ("!9", r"n\|b", "n|m", 1),
    ("", r"r\|n", "dn", 2),
    ("", r"n\|([aeiou]|wu)", "ny$1", 2),
    ("", r"n\|([fpbv])", "m$1", 2),
    ("", r"n\|h", "mp", 2),
    ("", r"n\|([nm])", "$1", 3),
    ("", r"(^|\|)k([^|])\|([^aeiou])", "$1g$2|$3", 2),
    ("", r"(^|\|)t([^|])\|([^aeiou])", "$1d$2|$3", 2),
    ("", r"w\|y", "w", 2),
    ("", r"y\|y", "y", 2),
    ("", r"y\|w", "w", 2),
    ("", r"ky\|([ie])", "k$1", 2),
    ("", r"gy\|e", "ge", 2),
    ("", r"kw\|([uo])", "k$1", 2),
    ("9", r"n\|y", "nz", 1),
    ("", r"a\|i", "e", 1),
    ("", r"a\|u", "o", 1),
    ("", r"[uo]\|([aeiou])", "w$1", 3),
    ("", r"[ie]\|([aeiou])", "y$1", 3),
    ("", r"(^|[aeiou])a\|([aeiou])", "$1$2", 3),
    ("", r"a\|([aeiou])", "y$1", 3),
    ("", r"\|", "", 1),
    ("", r"nts", "ns", 1),
    ("", r"nc", "nsh", 1),
    ("", r"mpf", "mf", 1),
    ("", r"zsh", "jsh", 1),
    ("", r"sj", "shj", 1),
    ("", r"ssh", "shsh", 1),
    ("", r"^(.*[eo].*[^aeiou])i(r|sh)", "$1e$2", 3),
    ("", r"^(.*o.*[^aeiou])ur", "$1or", 3),
]
