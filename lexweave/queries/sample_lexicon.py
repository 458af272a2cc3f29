"""Small word lists that occur in the sample text, so that lexicon and rule queries have matches.

Tables of the operators are parameters; these are the ones the registered queries pass.
"""

INVARIABLES = [
    ("and", "CONJUNCTION"), ("et", "CONJUNCTION"), ("und", "CONJUNCTION"), ("y", "CONJUNCTION"),
    ("but", "CONJUNCTION"), ("que", "CONJUNCTION"), ("and", "ADVERB"),
    ("in", "LOCATIVE"), ("dans", "LOCATIVE"), ("en", "LOCATIVE"), ("at", "LOCATIVE"), ("on", "LOCATIVE"),
    ("with", "PREPOSITION"), ("by", "PREPOSITION"), ("mit", "PREPOSITION"), ("con", "PREPOSITION"),
    ("for", "ADVERB"), ("as", "ADVERB"), ("par", "ADVERB"), ("als", "ADVERB"),
    ("to", "VERB_PARTICLE"), ("zu", "VERB_PARTICLE"),
    ("is", "VERB_CONJ"), ("are", "VERB_CONJ"), ("was", "VERB_CONJ"), ("ist", "VERB_CONJ"), ("est", "VERB_CONJ"),
]
PRONOUNS = [
    ("of", "POSSESSIVE", 1), ("de", "POSSESSIVE", 2), ("der", "POSSESSIVE", 3), ("la", "POSSESSIVE", 4),
    ("it", "PERSONAL", 9), ("that", "DEMONSTRATIVE", 5), ("this", "DEMONSTRATIVE", 6), ("die", "DEMONSTRATIVE", 7),
    ("qui", "RELATIVE", 8), ("of", "REFLEXIVE", 9), ("in", "PERSONAL", 3),
]
KNOWN_WORDS = [
    ("the", 9, "the"), ("le", 9, "le"), ("das", 10, "das"), ("the", 1, "he"), ("or", 4, "or"), ("he", 1, "he"),
]
# prefix, class, shortest, letter after, ending, strip
PREFIXES = [
    ("th", 1, 5, "", "", 2), ("re", 3, 4, "C", "", 2), ("on", 9, 4, "", "N", 2), ("er", 10, 4, "", "", 1),
    ("an", 4, 4, "V", "", 2), ("st", 6, 5, "", "", 2), ("in", 5, 5, "C", "N", 2), ("en", 7, 4, "C", "", 2),
    ("ge", 8, 5, "", "", 2), ("le", 2, 4, "", "", 2), ("con", 11, 5, "", "", 3), ("que", 12, 5, "", "", 3),
]
# ending -> part of speech of an open word
VERB_ENDING, ADJ_ENDING, INF_ENDING = "ing", "ed", "er"
FUSED = ["the", "and", "und", "les", "des", "para"]

ROLES = [
    ("but", "ADVERSATIVE"), ("ein", "ADVERSATIVE"), ("un", "ADVERSATIVE"),
    ("and", "COORDINATOR"), ("et", "COORDINATOR"), ("und", "COORDINATOR"),
    ("for", "SEQUENTIAL"), ("par", "SEQUENTIAL"),
    ("was", "LIST_PREDICATE"), ("las", "LIST_PREDICATE"),
    ("as", "SPEECH"), ("que", "SPEECH"),
    ("it", "INTERROGATIVE"), ("une", "INTERROGATIVE"),
    ("this", "EXCLAMATIVE"), ("los", "EXCLAMATIVE"), ("an", "INITIAL_EXCLAMATIVE"),
    ("is", "COPULA"), ("est", "COPULA"),
    ("and", "CONDITIONAL"), ("or", "INITIAL_CONDITIONAL"),
    ("to", "PURPOSE"), ("to", "COMPLEMENT"), ("zu", "COMPLEMENT"),
    ("on", "TENS"), ("in", "PLACE"), ("en", "PLACE"),
]
# connector, elided form
ELISION = [("the", "th'"), ("le", "l'"), ("de", "d'"), ("la", "l'"), ("que", "qu'"), ("to", "t'")]
CONNECTORS = [
    (1, "of"), (2, "de"), (3, "of"), (4, "la"), (5, "der"), (6, "la"), (7, "des"), (8, "den"), (9, "la"), (10, "las"),
    (11, "del"), (12, "el"),
]
GLOSS_VERBS = [("is", "be"), ("are", "be"), ("ing", "do"), ("thing", "do"), ("is", "exist")]
GLOSS_NOUNS = [("the", "article"), ("he", "person"), ("tion", "act")]
GLOSS_WORDS = [("of", "of"), ("de", "of"), ("and", "and"), ("et", "and"), ("in", "in"), ("en", "in"), ("of", "from")]
CONNECTIVES = ["of", "de", "and", "et"]
